"""Explicit schemas of the tables. Natural keys stand where the service numbers
rows: a merchant is (user_id, canonical_name), a subscription is (user_id,
merchant, account_id)."""

LINE = ("user_id bigint, account_id bigint, posted_date date, amount_cents bigint, "
        "currency string, raw_descriptor string, source_file string")
ACCOUNT = ("account_id bigint, user_id bigint, label string, institution string, "
           "currency string, created_at timestamp")
MERCHANT = "user_id bigint, canonical_name string, category string"
MERCHANT_ALIAS = ("user_id bigint, scrubbed_pattern string, merchant string, "
                  "resolved_by string, confidence double")
TRANSACTION = ("user_id bigint, account_id bigint, posted_date date, amount_cents bigint, "
               "currency string, raw_descriptor string, scrubbed string, merchant string, "
               "source_file string, dedup_hash string")
CANDIDATES = "array<struct<name:string,score:double>>"
RESOLUTION_QUEUE = (f"user_id bigint, scrubbed string, txn_count bigint, "
                    f"candidates {CANDIDATES}, top_score double, reason string, status string")
DECISION = ("user_id bigint, scrubbed string, merchant string, ignore boolean, "
            "decided_at timestamp")
SUBSCRIPTION = ("user_id bigint, merchant string, account_id bigint, cadence string, "
                "period_days double, anchor_day int, current_amount_cents bigint, "
                "currency string, amount_cv double, charge_count bigint, first_seen date, "
                "last_seen date, next_due date, status string, confidence double")
PRICE_CHANGE = ("user_id bigint, merchant string, account_id bigint, effective_date date, "
                "old_amount_cents bigint, new_amount_cents bigint, pct_change double")
ATTEMPT = "kind string, key string, at timestamp"
TENANT_TABLES = ("account", "merchant", "merchant_alias", "raw_transaction",
                 "resolution_queue", "subscription", "price_change")
EXPORT_TABLES = ("account", "merchant", "raw_transaction", "subscription",
                 "price_change", "resolution_queue")
