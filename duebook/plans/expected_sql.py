"""The same results in SQL for DuckDB, written from the definitions and not from
the Spark plans: charges stay single rows, loops stay loops over lists, forecasts
are searched step by step."""

from __future__ import annotations

import re

from duebook.functions.descriptors import (DOMAIN_ENDINGS, PROCESSOR_INITIALS,
                                           PROCESSOR_PHRASES, STATE_CODES)
from duebook.operators.series import CADENCES

S = "user_id, merchant, account_id"


def scrub(column: str) -> str:
    def drop(e, pattern, option=""):
        return f"regexp_replace({e}, '{pattern}', ''{option})"
    e = f"trim(upper({column}))"
    prefix = ("^(?:(?:" + "|".join(PROCESSOR_INITIALS) + r")\s*\*+\s*|(?:"
              + "|".join(PROCESSOR_PHRASES) + r")\s+)")
    e = f"trim({drop(e, prefix.replace('^', '^(?:', 1) + ')+')})"
    e = f"trim({drop(e, chr(92) + '.(?:' + '|'.join(DOMAIN_ENDINGS) + ')' + chr(92) + 'b', ', ' + repr('g'))})"
    for _ in range(8):
        for p in (r"\s+\d{3}[-.\s]?\d{3}[-.\s]?\d{4}$", r"\s+\d{8,}$", r"\s+#\s*\w+$",
                  r"\s+\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?$", r"\s+(?:USA?|CAN?)$",
                  r"\s+X{2,}\d+$", r"\s+(?:REF|AUTH|INV|ID|TRN)[:#]?\s*\w+$"):
            e = drop(e, p)
        e = (rf"regexp_replace({e}, '^(.*\S)\s+(?:{'|'.join(STATE_CODES)})$', '\1')")
    e = f"regexp_replace({e}, '[^A-Z0-9 ]', ' ', 'g')"
    words = f"list_filter(string_split({e}, ' '), lambda t: t <> '')"
    kept = (f"list_filter({words}, lambda t, i: NOT regexp_full_match(t, '[0-9]+') "
            "OR (i = 1 AND length(t) <= 2))")
    kept = (f"list_filter({kept}, lambda t, i: i = 1 OR length(t) < 5 "
            "OR NOT regexp_matches(t, '[0-9]') OR NOT regexp_matches(t, '[A-Z]'))")
    return f"array_to_string({kept}, ' ')"


_CADENCE_ROWS = ", ".join(
    f"({i}, '{n}', CAST({p} AS DOUBLE), CAST({t} AS DOUBLE))" for i, (n, p, t) in enumerate(CADENCES))

CTES = {
    # -------------------------------------------------------------- inputs --
    "event_lines": """
        SELECT user_id, user_id % 3 AS account_id, CAST(ts AS DATE) AS posted_date,
               CAST(-round_even(value * 100, 0) AS BIGINT) AS amount_cents, 'USD' AS currency,
               'SQ *' || upper(event_type) || ' #' || (event_id % 97) AS raw_descriptor,
               'events-' || (event_id % 4) AS source_file
        FROM events""",
    "part_lines": """
        SELECT p_partkey // 40 + 1 AS user_id, p_partkey % 2 AS account_id,
               CAST(CASE p_partkey % 7 WHEN 0 THEN fin - CAST(back * 7 AS INTEGER)
                    WHEN 1 THEN fin - CAST(back * 14 AS INTEGER)
                    WHEN 2 THEN fin - CAST(floor(back * CAST(15.2 AS DOUBLE)) AS INTEGER)
                    WHEN 3 THEN fin - to_months(CAST(back AS INTEGER))
                    WHEN 4 THEN fin - to_months(CAST(back * 3 AS INTEGER))
                    WHEN 5 THEN fin - to_months(CAST(back * 6 AS INTEGER))
                    ELSE fin - to_months(CAST(back * 12 AS INTEGER)) END AS DATE) AS posted_date,
               -(CASE WHEN p_partkey % 9 = 4 THEN base + i * 7919 % 40000
                      WHEN p_partkey % 4 = 0 AND i * 2 > len THEN base + base // 10
                      ELSE base END) AS amount_cents,
               (['USD', 'USD', 'USD', 'EUR', 'JPY', 'KWD'])[p_partkey % 6 + 1] AS currency,
               (['', 'SQ *', 'PAYPAL *', 'POS DEBIT ', 'SP * '])[p_partkey % 5 + 1]
                 || upper(p_name) || ' ' || p_type
                 || (['', ' 866-579-7172', ' #A17', ' CA', ' 12/31 USA'])[i % 5 + 1]
                 AS raw_descriptor,
               'parts-' || (p_partkey % 3) AS source_file
        FROM (SELECT *, 2 + p_partkey % 11 AS len, i AS idx, 2 + p_partkey % 11 - i AS back,
                     DATE '2024-12-28' - CAST(p_partkey * 37 % 150 AS INTEGER) AS fin,
                     CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS base
              FROM part, range(0, 13) AS r(i) WHERE i <= 2 + p_partkey % 11) x
        WHERE NOT (p_partkey % 5 = 0 AND i = 2)""",
    "order_lines": """
        SELECT o_custkey AS user_id, CAST(1 AS BIGINT) AS account_id,
               CAST(o_orderdate AS DATE) AS posted_date,
               CAST(-round_even(o_totalprice * 100, 0) AS BIGINT) AS amount_cents,
               'USD' AS currency, o_orderpriority AS raw_descriptor,
               'orders-' || (o_orderkey % 8) AS source_file
        FROM orders""",
    "review_items": """
        SELECT o_custkey AS user_id, o_orderpriority AS scrubbed, count(*) AS txn_count,
               CAST(max(o_orderkey) % 101 AS DOUBLE) AS top_score, 'borderline' AS reason,
               (['pending', 'resolved', 'ignored'])[max(o_orderkey) % 3 + 1] AS status
        FROM orders GROUP BY ALL""",
    "attempt_log": """
        SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us,
               event_id, event_id % 7 = 0 AS cleared FROM events""",
    "attempt_limits": """
        SELECT * FROM (VALUES ('click', 8, 900), ('view', 5, 3600), ('error', 2, 86400),
               ('purchase', 3, 43200)) AS t(kind, lim, secs)""",
    "event_fields": """
        SELECT user_id, user_id % 3 AS account_id,
               'drop/' || user_id || '/' || (event_id // 65536) || '.csv' AS source_file,
               CAST(ts AS DATE) AS posted_date, (event_id // 65536 + user_id) % 4 AS k,
               CAST(round_even(value * 100, 0) AS BIGINT) AS cents,
               'SQ *' || upper(event_type) || ' #' || (event_id % 97) AS raw_descriptor
        FROM events""",
    "event_typed": """
        SELECT user_id, account_id, source_file, posted_date,
               CASE WHEN k = 3 THEN cents WHEN k = 2 AND cents = 0 THEN NULL ELSE -cents END
                 AS amount_cents, raw_descriptor, NOT (k = 2 AND cents = 0) AS usable, k
        FROM event_fields""",
    "event_facts": """
        SELECT user_id, source_file, count(*) FILTER (WHERE usable) AS rows_read,
               count(*) FILTER (WHERE NOT usable) AS rows_skipped, min(k) = 2 AS paired,
               coalesce(avg(CASE WHEN amount_cents > 0 THEN 1.0 ELSE 0.0 END)
                        FILTER (WHERE usable) > 0.7, false) AS sign_flipped
        FROM event_typed GROUP BY ALL""",
    "event_signed": """
        SELECT t.user_id, account_id, posted_date,
               CASE WHEN sign_flipped AND NOT paired THEN -amount_cents ELSE amount_cents END
                 AS amount_cents, 'USD' AS currency, raw_descriptor, source_file
        FROM event_typed t JOIN event_facts USING (user_id, source_file) WHERE usable""",
    # ---------------------------------------------------------- transactions --
    "part_names": f"""SELECT raw_descriptor, {scrub('raw_descriptor')} AS merchant
        FROM (SELECT DISTINCT raw_descriptor FROM part_lines)""",
    "part_txns": """SELECT l.*, merchant FROM part_lines l JOIN part_names USING (raw_descriptor)""",
    "event_names": f"""SELECT raw_descriptor, {scrub('raw_descriptor')} AS merchant
        FROM (SELECT DISTINCT raw_descriptor FROM event_lines)""",
    "event_txns": """SELECT l.*, merchant FROM event_lines l
        JOIN event_names USING (raw_descriptor)""",
    "order_names": f"""SELECT raw_descriptor, {scrub('raw_descriptor')} AS merchant
        FROM (SELECT DISTINCT raw_descriptor FROM order_lines)""",
    "order_txns": """SELECT l.*, merchant FROM order_lines l
        JOIN order_names USING (raw_descriptor)""",
    "part_event_txns": "SELECT * FROM part_txns UNION ALL BY NAME SELECT * FROM event_txns",
    # ------------------------------------------------------------- detection --
    "charges": f"""
        SELECT {S}, posted_date, -amount_cents AS amount, currency FROM @SRC
        WHERE merchant IS NOT NULL AND amount_cents < 0""",
    "as_of": "SELECT user_id, max(posted_date) AS as_of, count(*) AS rows FROM @SRC GROUP BY ALL",
    "cadence": f"SELECT * FROM (VALUES {_CADENCE_ROWS}) AS t(ordinal, cadence, period, tol)",
    "gaps": f"""
        SELECT {S}, posted_date - lag(posted_date) OVER (
                 PARTITION BY {S} ORDER BY posted_date) AS gap FROM charges""",
    "gap_fit": f"""
        SELECT {S}, ordinal, median(abs(gap - k * period)) AS dev, max(k) AS widest,
               count(*) FILTER (WHERE k > 1) AS skips, count(*) AS n
        FROM (SELECT *, greatest(1.0, round_even(gap / period, 0)) AS k
              FROM gaps JOIN cadence ON gap IS NOT NULL) GROUP BY ALL""",
    "dom": f"""
        SELECT {S}, day(posted_date) AS raw,
               CASE WHEN posted_date = last_day(posted_date) THEN 32 ELSE day(posted_date) END
                 AS folded FROM charges""",
    "dom_mid": f"""
        SELECT {S}, median(raw) AS raw_mid, median(folded) AS folded_mid, count(*) AS n
        FROM dom GROUP BY ALL""",
    "dom_fit": f"""
        SELECT {S}, any_value(trunc(raw_mid)) AS raw_anchor,
               any_value(trunc(folded_mid)) AS folded_anchor,
               CASE WHEN count(*) FILTER (WHERE abs(raw - trunc(raw_mid)) <= 3) * 3 < any_value(n) * 2
                    THEN CAST('inf' AS DOUBLE) ELSE median(abs(raw - raw_mid)) END AS raw_dev,
               CASE WHEN count(*) FILTER (WHERE abs(folded - trunc(folded_mid)) <= 3) * 3
                         < any_value(n) * 2
                    THEN CAST('inf' AS DOUBLE) ELSE median(abs(folded - folded_mid)) END AS folded_dev
        FROM dom JOIN dom_mid USING ({S}) GROUP BY ALL""",
    "dom_best": f"""
        SELECT {S}, raw_anchor,
               CASE WHEN (raw_dev, raw_anchor) <= (folded_dev, folded_anchor)
                    THEN raw_dev ELSE folded_dev END AS dev,
               CASE WHEN (raw_dev, raw_anchor) <= (folded_dev, folded_anchor)
                    THEN raw_anchor ELSE folded_anchor END AS anchor FROM dom_fit""",
    "fit": f"""
        SELECT {S}, cadence, period, score, anchor_day FROM (
          SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY score, ordinal) AS rn FROM (
            SELECT g.user_id, g.merchant, g.account_id, ordinal, cadence, period,
                   CASE WHEN cadence = 'monthly' THEN least(g.dev / tol, b.dev / tol)
                        ELSE g.dev / tol END AS score,
                   CAST(CASE WHEN cadence = 'monthly' THEN least(b.anchor, 31)
                             ELSE raw_anchor END AS INTEGER) AS anchor_day
            FROM gap_fit g JOIN cadence USING (ordinal) JOIN dom_best b USING ({S})
            WHERE widest <= 3 AND skips * 2 <= n) WHERE score <= 1.0) WHERE rn = 1""",
    "found": f"""
        SELECT {S}, cadence, period AS period_days, score AS norm_dev, anchor_day,
               count(*) AS charge_count, min(posted_date) AS first_seen,
               max(posted_date) AS last_seen, min(currency) AS currency
        FROM charges JOIN fit USING ({S}) GROUP BY ALL""",
    "current": f"""
        SELECT {S}, CAST(trunc(median(amount)) AS BIGINT) AS current_amount_cents FROM (
          SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY posted_date DESC, amount DESC)
                   AS rn FROM charges) WHERE rn <= 3 GROUP BY {S}""",
    "plain_cv": f"""
        SELECT {S}, CASE WHEN any_value(mid) = 0 THEN 0.0
                    ELSE median(abs(amount - mid)) / abs(any_value(mid)) END AS cv
        FROM charges JOIN (SELECT {S}, median(amount) AS mid FROM charges GROUP BY ALL)
             USING ({S}) GROUP BY {S}""",
    "series_lists": f"""
        SELECT {S}, list({{'d': posted_date, 'a': amount, 'nx': nx, 'nr': rn}}
                         ORDER BY posted_date, amount, rn) AS l
        FROM (SELECT *, lead(amount) OVER w AS nx, row_number() OVER w AS rn FROM charges
              WINDOW w AS (PARTITION BY {S} ORDER BY posted_date, amount)) GROUP BY {S}""",
    "folded": f"""
        SELECT {S}, l, list_reduce(l, lambda acc, x:
          CASE WHEN len(acc.run) = 0
               THEN {{'run': [x.a], 'steps': acc.steps}}
               WHEN abs(x.a - list_aggregate(acc.run, 'median')) / list_aggregate(acc.run, 'median')
                    <= CAST(0.02 AS DOUBLE)
               THEN {{'run': list_append(acc.run, x.a), 'steps': acc.steps}}
               WHEN x.nx IS NOT NULL AND abs(x.nx - x.a) / CAST(x.a AS DOUBLE) <= CAST(0.02 AS DOUBLE)
               THEN {{'run': [x.a], 'steps': list_append(acc.steps, {{'d': x.d,
                      'o': CAST(trunc(list_aggregate(acc.run, 'median')) AS BIGINT), 'n': x.a,
                      'nr': x.nr}})}}
               ELSE acc END,
          {{'run': []::BIGINT[],
            'steps': []::STRUCT(d DATE, o BIGINT, n BIGINT, nr BIGINT)[]}}).steps AS steps
        FROM series_lists""",
    "all_steps": f"""
        SELECT {S}, s.d AS effective_date, s.o AS old_amount_cents, s.n AS new_amount_cents, s.nr
        FROM (SELECT {S}, unnest(steps) AS s FROM folded)""",
    "steps": f"""
        SELECT {S}, effective_date, arg_min(old_amount_cents, nr) AS old_amount_cents,
               arg_min(new_amount_cents, nr) AS new_amount_cents
        FROM all_steps GROUP BY {S}, effective_date""",
    "segments": f"""
        SELECT {S}, amount, sum(cut) OVER (PARTITION BY {S} ORDER BY d, amount, nr
                 ROWS UNBOUNDED PRECEDING) AS seg
        FROM (SELECT {S}, x.d AS d, x.a AS amount, x.nr AS nr,
                     CASE WHEN list_contains(list_transform(steps, lambda s: s.d), x.d)
                          THEN 1 ELSE 0 END AS cut
              FROM (SELECT {S}, steps, unnest(l) AS x FROM folded))""",
    "level_cv": f"""
        SELECT {S}, max(cv) AS cv FROM (
          SELECT {S}, seg, median(abs(amount - mid)) / any_value(mid) AS cv
          FROM segments JOIN (SELECT {S}, seg, median(amount) AS mid FROM segments GROUP BY ALL)
               USING ({S}, seg) GROUP BY {S}, seg) GROUP BY {S}""",
    "due": f"""
        SELECT {S}, coalesce(min(due) FILTER (WHERE due > as_of), max(due)) AS next_due FROM (
          SELECT {S}, as_of,
                 CASE WHEN cadence IN ('monthly', 'semimonthly')
                      THEN CAST(first AS DATE) + CAST(least(anchor_day, day(last_day(first))) - 1
                                                      AS INTEGER)
                      ELSE last_seen + CAST(round_even(period_days, 0) * step AS INTEGER) END AS due
          FROM (SELECT *, date_trunc('month', last_seen) + to_months(CAST(step AS INTEGER)) AS first
                FROM found JOIN as_of USING (user_id), range(1, 900) AS r(step)))
        GROUP BY {S}""",
    "assembled": f"""
        SELECT {S}, cadence, period_days, anchor_day, current_amount_cents, currency,
               round_even(cv * 1000, 0) / 1000 AS amount_cv, charge_count, first_seen, last_seen,
               next_due,
               CASE WHEN as_of - last_seen > 2.5 * period_days THEN 'cancelled'
                    WHEN as_of - last_seen > 1.5 * period_days THEN 'lapsed'
                    ELSE 'active' END AS status,
               round_even((CAST(0.45 AS DOUBLE) * least(CAST(1 AS DOUBLE), (charge_count - 1) / 4)
                 + CAST(0.40 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - norm_dev)
                 + CAST(0.15 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - least(cv, 1))) * 1000, 0)
                 / 1000 AS confidence, cv
        FROM found JOIN current USING ({S}) JOIN @CV USING ({S}) JOIN due USING ({S})
             JOIN as_of USING (user_id)""",
    "subs": "SELECT * EXCLUDE (cv) FROM assembled",
    "changes": f"""
        SELECT steps.*, round_even((new_amount_cents - old_amount_cents) / old_amount_cents
                 * 100 * 100, 0) / 100 AS pct_change
        FROM steps SEMI JOIN (SELECT {S} FROM assembled WHERE cv <= 0.02) USING ({S})""",
    "costed": """
        SELECT s.*, CAST(round_even(current_amount_cents * CAST(365.25 AS DOUBLE) / period_days, 0)
                    AS BIGINT) AS annual_cents, amount_cv > 0.02 AS usage_based,
               CASE currency WHEN 'JPY' THEN 0 WHEN 'KWD' THEN 3 ELSE 2 END AS minor_digits
        FROM subs s""",
    "summary": f"""
        SELECT user_id, as_of, currency, coalesce(annual_minor, 0) AS annual_minor,
               CAST(round_even(coalesce(annual_minor, 0) / 12, 0) AS BIGINT) AS monthly_minor,
               coalesce(active_count, 0) AS active_count,
               coalesce(inactive_count, 0) AS inactive_count,
               coalesce(effect, 0) AS price_increase_annual_minor,
               coalesce(minor_digits, 2) AS minor_digits,
               coalesce(awaiting_review, 0) AS awaiting_review
        FROM as_of
        FULL JOIN (SELECT user_id, count(*) AS awaiting_review FROM review_items
                   WHERE status = 'pending' GROUP BY ALL) USING (user_id)
        LEFT JOIN (SELECT user_id, currency,
                     CAST(coalesce(sum(annual_cents) FILTER (WHERE status = 'active'), 0) AS BIGINT)
                       AS annual_minor, count(*) FILTER (WHERE status = 'active') AS active_count,
                     count(*) FILTER (WHERE status <> 'active') AS inactive_count,
                     any_value(minor_digits) AS minor_digits FROM costed GROUP BY ALL) USING (user_id)
        LEFT JOIN (SELECT user_id, currency, CAST(sum(round_even(
                     (new_amount_cents - old_amount_cents) * CAST(365.25 AS DOUBLE) / period_days, 0))
                     AS BIGINT) AS effect FROM changes JOIN subs USING ({S}) GROUP BY ALL)
             USING (user_id, currency)""",
    "truth": """
        SELECT user_id, merchant, CASE WHEN count(*) = 1 THEN min(c) END AS expected FROM (
          SELECT p_partkey // 40 + 1 AS user_id, upper(p_name) || ' ' || p_type AS merchant,
                 (['weekly', 'biweekly', 'semimonthly', 'monthly', 'quarterly', 'semiannual',
                   'annual'])[p_partkey % 7 + 1] AS c FROM part) GROUP BY user_id, merchant""",
    "judged": """
        SELECT user_id, merchant, expected, detected,
               CASE WHEN expected IS NOT NULL AND detected IS NOT NULL THEN 'TP'
                    WHEN expected IS NOT NULL THEN 'FN' WHEN detected IS NOT NULL THEN 'FP'
                    ELSE 'TN' END AS outcome,
               coalesce(expected <> detected, false) AS wrong_cadence
        FROM truth LEFT JOIN (SELECT user_id, merchant, arg_min(cadence, account_id) AS detected
                              FROM subs GROUP BY ALL) USING (user_id, merchant)""",
    "two_uploads": """
        SELECT * FROM (
          SELECT user_id, account_id, posted_date, amount_cents // 500 * 500 AS amount_cents,
                 split_part(raw_descriptor, ' #', 1) AS raw_descriptor, f.source_file
          FROM (SELECT user_id, account_id, posted_date,
                       CAST(floor(amount_cents / 500) * 500 AS BIGINT) AS amount_cents,
                       raw_descriptor FROM event_lines) e,
               (VALUES ('a.csv'), ('b.csv')) AS f(source_file))
        WHERE source_file = 'a.csv' OR account_id < 2""",
    "upload_occurrences": """
        SELECT *, row_number() OVER (PARTITION BY user_id, source_file, account_id, posted_date,
                 amount_cents, raw_descriptor) - 1 AS occurrence FROM two_uploads""",
    "upload_once": """
        SELECT user_id, account_id, posted_date, amount_cents, raw_descriptor, occurrence,
               min(source_file) AS source_file,
               sha256(concat_ws('|', user_id, account_id, posted_date, amount_cents,
                                raw_descriptor, occurrence)) AS dedup_hash
        FROM upload_occurrences GROUP BY ALL""",
}


def q(final: str, src: str = "part_txns", cv: str = "level_cv") -> str:
    """`final` with the CTEs it needs in front."""
    def fill(text):
        return text.replace("@SRC", src).replace("@CV", cv)

    needed: list[str] = []

    def visit(text):
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                body = fill(CTES[name])
                visit(body)
                if name not in needed:
                    needed.append(name)

    final = fill(final)
    visit(final)
    if not needed:
        return final
    head = "WITH " + ",\n".join(f"{n} AS ({fill(CTES[n])})" for n in needed)
    own = final.lstrip()
    return head + (",\n" + own[4:] if own.startswith("WITH") else "\n" + final)


_PRICE = "CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)"
_UNITS = f"({_PRICE} // 100)"
_REST = f"lpad(CAST({_PRICE} % 100 AS VARCHAR), 2, '0')"
_US = f"format('{{:,}}', {_UNITS})"
_FORM = "(l_orderkey + l_linenumber) % 8"
_MON = "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month(d)]"
_CURRENCY = "(['usd', 'JPY', 'KWD', 'EUR'])[o_orderkey % 4 + 1]"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by bits, for two strings up to 60 characters."""
    mask = (f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN ({a})[i + 1] = x.c "
            "THEN 1::BIGINT << i ELSE 0 END))::BIGINT")
    return (f"(length({a}) - bit_count(list_reduce(list_transform(string_split({b}, ''), "
            "lambda ch: {'s': 0::BIGINT, 'c': ch}), lambda st, x: {'s': "
            f"((st.s + (st.s & {mask})) | (st.s - (st.s & {mask}))) "
            f"& ((1::BIGINT << length({a})) - 1), 'c': x.c}}, "
            f"{{'s': (1::BIGINT << length({a})) - 1, 'c': ''}}).s))")


def score_ctes(pairs: str) -> str:
    """CTEs up to pair_scores(a, b, token_set, partial, held) for the distinct
    (a, b) that the query text `pairs` selects."""
    return f"""
pair AS ({pairs}),
sets AS (SELECT *, list_sort(list_distinct(string_split(a, ' '))) AS sa,
                list_sort(list_distinct(string_split(b, ' '))) AS sb FROM pair),
left_over AS (SELECT *, array_to_string(list_filter(sa, lambda t: NOT list_contains(sb, t)), ' ')
                     AS da,
                array_to_string(list_filter(sb, lambda t: NOT list_contains(sa, t)), ' ') AS db,
                length(array_to_string(list_filter(sa, lambda t: list_contains(sb, t)), ' ')) AS s
         FROM sets),
scored AS (SELECT *, CASE WHEN s > 0 THEN 1 ELSE 0 END AS sp, length(da) AS na, length(db) AS nb,
                  CASE WHEN da = '' OR db = '' THEN 0 ELSE {lcs('da', 'db')} END AS l
           FROM left_over),
windows AS (SELECT a, b, w, sh FROM (
    SELECT a, b, sh, unnest(list_transform(range(1 - length(sh), length(lo)), lambda k:
             substring(lo, greatest(k, 0) + 1, least(k + length(sh), length(lo)) - greatest(k, 0))))
             AS w
    FROM (SELECT a, b, a AS sh, b AS lo FROM pair WHERE length(a) <= length(b)
          UNION ALL SELECT a, b, b, a FROM pair WHERE length(b) <= length(a)))),
window_scores AS (SELECT sh, w, (1 - CAST(length(sh) + length(w) - 2 * {lcs('sh', 'w')} AS DOUBLE)
                      / (length(sh) + length(w))) * 100 AS score
                  FROM (SELECT DISTINCT sh, w FROM windows)),
part_score AS (SELECT a, b, max(score) AS partial FROM windows JOIN window_scores USING (sh, w)
               GROUP BY ALL),
pair_scores AS (SELECT a, b, CASE WHEN s > 0 AND (na = 0 OR nb = 0) THEN 100.0 ELSE greatest(
         100 - 100 * CAST(na + nb - 2 * l AS DOUBLE) / (2 * (s + sp) + na + nb),
         CASE WHEN s > 0 THEN 100 - 100 * CAST(1 + na AS DOUBLE) / (2 * s + 1 + na) ELSE 0 END,
         CASE WHEN s > 0 THEN 100 - 100 * CAST(1 + nb AS DOUBLE) / (2 * s + 1 + nb) ELSE 0 END)
         END AS token_set, partial,
       least(length(replace(a, ' ', '')), length(replace(b, ' ', ''))) >= 5
       AND (contains(replace(b, ' ', ''), replace(a, ' ', ''))
            OR contains(replace(a, ' ', ''), replace(b, ' ', ''))) AS held
  FROM scored JOIN part_score USING (a, b))"""


_SIMILARITY = f"""
WITH here AS (SELECT p_partkey, upper(p_name) || ' ' || p_type AS a FROM part),
pairs AS (SELECT x.a, y.a AS b FROM here x JOIN here y ON y.p_partkey = x.p_partkey + 1
          UNION ALL SELECT a, replace(a, ' ', '') FROM here),
{score_ctes("SELECT DISTINCT a, b FROM pairs")}
SELECT a, b, parts, round(token_set, 6) AS token_set, round(partial, 6) AS partial, held
FROM pair_scores JOIN (SELECT a, b, count(*) AS parts FROM pairs GROUP BY ALL) USING (a, b)"""

# The sequential ladder: names in rank order, each one compared with the founders
# before it.
_LADDER = f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, name) AS rk
                FROM (SELECT user_id, merchant AS name, count(*) AS n FROM part_txns GROUP BY ALL)),
{score_ctes("""SELECT DISTINCT d.name AS a, k.name AS b
               FROM ranked d JOIN ranked k ON d.user_id = k.user_id AND k.rk < d.rk""")},
close AS (SELECT d.user_id, d.rk, list(k.rk) AS rel
          FROM ranked d JOIN ranked k ON d.user_id = k.user_id AND k.rk < d.rk
          JOIN pair_scores ON a = d.name AND b = k.name
          WHERE length(d.name) >= 4 AND (token_set >= 72 OR partial >= 85 OR held)
          GROUP BY d.user_id, d.rk),
chosen AS (SELECT user_id, unnest(list_reduce(list({{'rk': rk, 'rel': coalesce(rel, [])}} ORDER BY rk),
             lambda acc, x: CASE WHEN list_has_any(acc.ks, x.rel) THEN acc
                                 ELSE {{'ks': list_append(acc.ks, x.rk)}} END,
             {{'ks': []::BIGINT[]}}).ks) AS rk
           FROM ranked LEFT JOIN close USING (user_id, rk) GROUP BY user_id),
founded AS (SELECT user_id, name, n, rk FROM ranked JOIN chosen USING (user_id, rk)),
hits AS (SELECT d.user_id, d.name, d.n, k.name AS known, token_set, partial, held,
                row_number() OVER (PARTITION BY d.user_id, d.name ORDER BY token_set DESC, k.rk) AS tr,
                row_number() OVER (PARTITION BY d.user_id, d.name ORDER BY partial DESC, k.rk) AS pr,
                row_number() OVER (PARTITION BY d.user_id, d.name, held ORDER BY k.rk) AS hr
         FROM (SELECT * FROM ranked ANTI JOIN founded USING (user_id, rk)) d
         JOIN founded k ON d.user_id = k.user_id AND k.rk < d.rk
         JOIN pair_scores ON a = d.name AND b = k.name),
shown AS (SELECT *, known || ':' || CAST(CAST(round_even(token_set * 1000, 0) AS BIGINT) AS VARCHAR) AS tt,
                 known || ':' || CAST(CAST(round_even(partial * 1000, 0) AS BIGINT) AS VARCHAR) AS pt
          FROM hits),
best AS (SELECT user_id, name, n, count(*) AS c, max(token_set) AS t1,
                max(token_set) FILTER (WHERE tr = 2) AS t2, max(partial) AS p1,
                max(partial) FILTER (WHERE held AND hr = 1) AS h1, arg_min(known, tr) AS top,
                string_agg(tt, '|' ORDER BY tr) FILTER (WHERE tr <= 5) AS tok,
                string_agg(pt, '|' ORDER BY pr) FILTER (WHERE pr <= 3) AS par,
                string_agg(pt, '|' ORDER BY hr) FILTER (WHERE held AND hr <= 3) AS hel
         FROM shown GROUP BY user_id, name, n),
verdicts AS (SELECT *, CASE WHEN c > 1 AND t1 - t2 <= 4 AND t2 >= 72 THEN 'ambiguous'
                    WHEN t1 >= 90 THEN 'match' WHEN t1 >= 72 THEN 'borderline'
                    ELSE 'suspect' END AS verdict,
               CASE WHEN t1 >= 72 THEN tok WHEN p1 >= 85 THEN par ELSE hel END AS candidates,
               CASE WHEN t1 >= 72 THEN t1 WHEN p1 >= 85 THEN p1 ELSE h1 END AS score FROM best),
outcomes AS (
  SELECT user_id, name AS scrubbed, n, CASE WHEN verdict = 'match' THEN 'fuzzy' ELSE 'queued' END AS tier,
         CASE WHEN verdict = 'match' THEN top END AS merchant, round(score, 6) AS score, verdict,
         candidates FROM verdicts
  UNION ALL SELECT user_id, name, n, 'new', name, NULL, 'unknown', NULL FROM founded)
"""

_FOUND = f"""SELECT {S}, cadence, period_days, round(norm_dev, 6) AS norm_dev, anchor_day,
    charge_count, first_seen, last_seen FROM found"""

EXPECTED = {
    "scrub_descriptors": q(f"""
        SELECT raw_descriptor, lines, {scrub('raw_descriptor')} AS scrubbed FROM (
          SELECT raw_descriptor, count(*) AS lines FROM (
            SELECT raw_descriptor FROM part_lines
            UNION ALL SELECT raw_descriptor FROM event_lines
            UNION ALL SELECT 'CHECKCARD 0803 ' || c_name || ' ' || c_mktsegment
                             || ' 408-536-6000 NY' FROM customer) GROUP BY ALL)"""),
    "parsed_amounts": f"""
        SELECT l_orderkey, l_linenumber, CASE {_FORM}
                 WHEN 0 THEN '$' || {_US} || '.' || {_REST}
                 WHEN 1 THEN '-' || replace({_US}, ',', '.') || ',' || {_REST}
                 WHEN 2 THEN '(' || {_US} || '.' || {_REST} || ')'
                 WHEN 3 THEN replace({_US}, ',', ' ') || ',' || {_REST}
                 WHEN 4 THEN ' ' || {_US} || ' USD'
                 WHEN 5 THEN {_US} || '.00'
                 WHEN 6 THEN {_UNITS} || '.' || {_REST} || '0'
                 ELSE {_US} || '.' || {_REST} || '.' || {_REST} END AS raw,
               CASE {_FORM} WHEN 5 THEN 'JPY' WHEN 6 THEN 'KWD' ELSE 'USD' END AS currency,
               CASE {_FORM} WHEN 0 THEN {_PRICE} WHEN 1 THEN -{_PRICE} WHEN 2 THEN -{_PRICE}
                 WHEN 3 THEN {_PRICE} WHEN 4 THEN {_UNITS} * 100 WHEN 5 THEN {_UNITS}
                 WHEN 6 THEN {_PRICE} * 10
                 ELSE CASE WHEN {_UNITS} < 1000 THEN NULL ELSE NULL END END AS amount
        FROM lineitem""",
    "parsed_dates": f"""
        SELECT o_orderkey, CASE f WHEN 0 THEN strftime(d, '%m/%d/%Y')
                 WHEN 1 THEN month(d) || '/' || day(d) || '/' || strftime(d, '%y')
                 WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%m-%d-%Y')
                 WHEN 4 THEN year(d) || '/' || month(d) || '/' || day(d)
                 WHEN 5 THEN strftime(d, '%d-') || {_MON} || strftime(d, '-%Y')
                 WHEN 6 THEN {_MON} || ' ' || day(d) || ', ' || year(d)
                 WHEN 7 THEN day(d) || ' ' || {_MON} || ' ' || year(d)
                 WHEN 8 THEN strftime(d, '%d.%m.%Y') WHEN 9 THEN strftime(d, '%d-%m-%y')
                 WHEN 10 THEN strftime(d, '%y-%m-%d')
                 WHEN 11 THEN strftime(d, '%d-') || {_MON} || strftime(d, '-%y')
                 WHEN 12 THEN strftime(d, '%Y-') || {_MON} || strftime(d, '-%d')
                 WHEN 13 THEN strftime(d, '%Y%m%d')
                 ELSE strftime(d, '%Y-%m-%d') || ' 00:00' END AS raw,
               CASE WHEN f < 9 THEN d END AS month_first,
               CASE WHEN f > 8 THEN NULL WHEN f IN (0, 1, 3) THEN CASE WHEN day(d) <= 12
                    THEN make_date(year(d), day(d), month(d)) END
                    WHEN f = 6 THEN NULL ELSE d END AS day_first
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 15 AS f FROM orders)""",
    "money_columns": f"""
        SELECT o_orderkey, currency, digits, minor,
               CASE digits WHEN 0 THEN format('{{:,}}', minor)
                 WHEN 2 THEN format('{{:,}}', minor // 100) || '.'
                             || lpad(CAST(minor % 100 AS VARCHAR), 2, '0')
                 ELSE format('{{:,}}', minor // 1000) || '.'
                             || lpad(CAST(minor % 1000 AS VARCHAR), 3, '0') END
                 || ' ' || upper(currency) AS shown,
               CAST(round_even(minor * CAST(365.25 AS DOUBLE) / CAST(30.44 AS DOUBLE), 0) AS BIGINT)
                 AS annual
        FROM (SELECT *, CAST(round_even(o_totalprice * (CASE digits WHEN 0 THEN 1 WHEN 2 THEN 100
                             ELSE 1000 END), 0) AS BIGINT) AS minor
              FROM (SELECT o_orderkey, o_totalprice, {_CURRENCY} AS currency,
                           CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS digits
                    FROM orders))""",
    "dedup_keys": q("""
        SELECT *, sha256(concat_ws('|', user_id, account_id, posted_date, amount_cents,
                                   raw_descriptor, occurrence)) AS dedup_hash
        FROM (SELECT user_id, account_id, posted_date, amount_cents, raw_descriptor, source_file,
                     row_number() OVER (PARTITION BY user_id, source_file, account_id, posted_date,
                       amount_cents, raw_descriptor) - 1 AS occurrence FROM event_lines)"""),
    "statement_lines": q("SELECT * EXCLUDE (k) FROM event_typed"),
    "split_statement_lines": """
        WITH e AS (SELECT *, event_id % 4 AS k, CAST(round_even(value * 100, 0) AS BIGINT) AS cents
                   FROM events)
        SELECT k + 1 AS user_id, event_id // 65536 AS account_id, CAST(ts AS DATE) AS posted_date,
               CASE WHEN k = 3 THEN cents WHEN k = 2 AND cents = 0 THEN NULL ELSE -cents END
                 AS amount_cents,
               'SQ *' || upper(event_type) || ' #' || (event_id % 97)
                 || CASE WHEN event_id % 5 = 0 THEN chr(10) || 'SAID ' || (event_id % 97) || ', 1; '
                      || event_id ELSE '' END AS raw_descriptor,
               NOT (k = 2 AND cents = 0) AS usable FROM e""",
    "statement_files": q("SELECT * FROM event_facts"),
    "signed_statement_lines": q("SELECT * FROM event_signed"),
    "sign_conventions": q("""
        WITH l AS (SELECT * REPLACE (CASE WHEN day(posted_date) % 8 < 1 + user_id % 7
                          THEN -amount_cents ELSE amount_cents END AS amount_cents)
                   FROM order_lines),
        f AS (SELECT user_id, source_file, avg(CASE WHEN amount_cents > 0 THEN 1 ELSE 0 END) > 0.7
                     AS sign_flipped FROM l GROUP BY ALL)
        SELECT user_id, source_file, count(*) AS lines,
               CAST(sum(CASE WHEN sign_flipped THEN -amount_cents ELSE amount_cents END) AS BIGINT)
                 AS total_cents, sign_flipped
        FROM l JOIN f USING (user_id, source_file) GROUP BY ALL"""),
    "idempotent_load": q(f"""
        SELECT user_id, account_id, posted_date, amount_cents, 'USD' AS currency, raw_descriptor,
               {scrub('raw_descriptor')} AS scrubbed, source_file, dedup_hash
        FROM upload_once WHERE day(posted_date) > 10"""),
    "reload_is_noop": q("""SELECT count(*) AS first_load, CAST(0 AS BIGINT) AS second_load
        FROM upload_once"""),
    "account_upsert": """
        SELECT CAST(c_nationkey AS BIGINT) AS user_id, c_mktsegment AS label,
               CAST(NULL AS VARCHAR) AS institution,
               CASE WHEN bool_or(c_custkey % 13 = 0) THEN 'USD' ELSE 'EUR' END AS currency,
               TIMESTAMP '2026-01-01' AS created_at
        FROM customer GROUP BY c_nationkey, c_mktsegment""",
    "merged_keep_first": """
        SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                   ORDER BY o_orderkey % 2, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    "queue_upsert": q("""
        SELECT user_id, scrubbed,
               CASE WHEN user_id % 2 = 1 OR user_id % 3 = 0 THEN txn_count * 10
                    ELSE txn_count END AS txn_count,
               CASE WHEN user_id % 2 = 1 OR user_id % 3 = 0 THEN NULL ELSE top_score END
                 AS top_score,
               CASE WHEN user_id % 2 = 0 THEN reason ELSE 'ambiguous' END AS reason,
               CASE WHEN user_id % 2 = 0 THEN status ELSE 'pending' END AS status
        FROM review_items"""),
    "tenant_rows": q("""SELECT * EXCLUDE (merchant), merchant AS scrubbed FROM event_txns
        WHERE user_id = 7"""),
    "no_tenant_rows": q("""SELECT user_id, count(*) AS rows FROM event_txns
        WHERE user_id % 3 > 0 AND user_id IN (SELECT c_custkey FROM customer
                                              WHERE c_custkey % 2 = 1) GROUP BY user_id"""),
    "rejected_files": q("""
        SELECT CASE WHEN k <> 6 THEN user_id END AS user_id,
               replace(source_file, '/', '-') || CASE WHEN k = 5 THEN '.png' ELSE '' END AS file,
               CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'binary' WHEN 2 THEN 'no usable rows'
                    WHEN 3 THEN 'no amount or debit column'
                    WHEN 4 THEN 'no date or description column'
                    WHEN 5 THEN 'not a .csv, .txt or .tsv file' WHEN 6 THEN 'no user'
                    WHEN 7 THEN 'account label above 64 characters'
                    WHEN 8 THEN 'currency is not three letters' WHEN 9 THEN 'not text'
                    ELSE 'no usable rows' END AS reason
        FROM (SELECT DISTINCT user_id, source_file, user_id % 12 AS k FROM event_fields)
        WHERE k < 11"""),
    "erased_tables": q("""
        WITH gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 5 = 0)
        SELECT user_id, count(*) AS rows, 'order' AS source FROM order_lines
        WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY user_id
        UNION ALL SELECT user_id, count(*), 'event' FROM event_lines
        WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY user_id"""),
    "purged_attempts": """
        SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS key, event_id FROM events
        WHERE ts >= TIMESTAMP '2024-01-19'""",
    "replaced_derived": """
        SELECT user_id, count(*) * CASE WHEN user_id % 4 = 1 THEN 100 ELSE 1 END AS charges
        FROM events GROUP BY user_id""",
    "backfilled_currency": q(f"""
        SELECT {S}, min(t.currency) AS currency FROM found
        JOIN part_txns t USING ({S}) GROUP BY {S}"""),
    "name_similarity": _SIMILARITY,
    "unresolved_descriptors": q("""SELECT user_id, merchant AS scrubbed, count(*) AS n
        FROM part_txns GROUP BY ALL"""),
    "exact_tier": q("""SELECT user_id, 'M ' || merchant AS merchant, count(*) AS charges
        FROM event_txns GROUP BY ALL"""),
    "founders": q(_LADDER + "SELECT user_id, name AS scrubbed, n FROM founded"),
    "resolution_outcomes": q(_LADDER + "SELECT * FROM outcomes"),
    "resolution_tiers": q(_LADDER + """SELECT user_id, tier, CAST(sum(n) AS BIGINT) AS transactions
        FROM outcomes GROUP BY ALL"""),
    "resolved_transactions": q(_LADDER + """
        SELECT t.user_id, o.merchant, t.account_id, o.scrubbed, posted_date, amount_cents
        FROM part_txns t JOIN outcomes o ON t.user_id = o.user_id AND t.merchant = o.scrubbed"""),
    "resolved_aliases": q(_LADDER + """
        SELECT user_id, scrubbed AS scrubbed_pattern, merchant,
               CASE WHEN tier = 'fuzzy' THEN 'fuzzy' ELSE 'exact' END AS resolved_by,
               CASE WHEN tier = 'fuzzy' THEN round_even(score * 10, 0) / 1000 END AS confidence
        FROM outcomes WHERE tier IN ('new', 'fuzzy')"""),
    "queued_candidates": q(_LADDER + """
        SELECT user_id, scrubbed, n AS txn_count, round_even(score * 100, 0) / 100 AS top_score,
               verdict AS reason, candidates FROM outcomes WHERE tier = 'queued'"""),
    "review_decisions": q("""
        SELECT user_id, scrubbed, CASE WHEN status <> 'pending' OR user_id % 4 = 3 THEN
                 CASE WHEN amount_cents % 2 = 0 THEN 'OLD' END
                 WHEN user_id % 4 = 0 THEN scrubbed ELSE c_mktsegment END AS merchant,
               count(*) AS charges,
               CASE WHEN status <> 'pending' THEN status WHEN user_id % 4 = 3 THEN 'ignored'
                    ELSE 'resolved' END AS status
        FROM (SELECT o.user_id, raw_descriptor AS scrubbed, amount_cents FROM order_lines o)
        JOIN review_items USING (user_id, scrubbed)
        JOIN (SELECT c_custkey AS user_id, c_mktsegment FROM customer) USING (user_id)
        GROUP BY ALL"""),
    "charge_points": q("""SELECT *, count(*) AS n FROM charges GROUP BY ALL""",
                       "part_event_txns"),
    "as_of_dates": q("SELECT * FROM as_of", "order_txns"),
    "part_cadences": q(_FOUND),
    "event_cadences": q(_FOUND, "event_txns"),
    "order_cadences": q(_FOUND, "order_txns"),
    "day_anchors": q(f"""SELECT {S}, CAST(raw_anchor AS BIGINT) AS day_anchor,
        CAST(folded_anchor AS BIGINT) AS folded_anchor FROM dom_fit"""),
    "current_amounts": q("SELECT * FROM current", "part_event_txns"),
    "robust_cv": q(f"SELECT {S}, round(cv, 6) AS cv FROM plain_cv", "order_txns"),
    "plain_subscriptions": q("SELECT * FROM subs", cv="plain_cv"),
    "price_steps": q("SELECT * FROM steps"),
    "segmented_cv": q(f"SELECT {S}, round(cv, 6) AS cv FROM level_cv"),
    "subscriptions": q("SELECT * FROM subs"),
    "event_subscriptions": q("SELECT * FROM subs", "event_txns"),
    "price_changes": q("SELECT * FROM changes"),
    "spending_by_currency": q("SELECT * FROM summary"),
    "spending_summary": q("""
        SELECT user_id, as_of AS statement_through, currency,
               round(annual_minor / pow(10, minor_digits), 3) AS annual,
               round(monthly_minor / pow(10, minor_digits), 3) AS monthly,
               active_count AS active_subscriptions, inactive_count AS inactive_subscriptions,
               round(price_increase_annual_minor / pow(10, minor_digits), 3)
                 AS annual_cost_added_by_price_rises,
               awaiting_review AS descriptors_awaiting_review FROM summary"""),
    "subscription_list": q(f"""
        SELECT {S}, CAST(position AS INTEGER) AS position, annual_cents, usage_based, minor_digits
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY current_amount_cents * (CAST(365.25 AS DOUBLE) / period_days) DESC,
                merchant, account_id) AS position FROM costed)"""),
    "subscription_page": q(f"""
        SELECT {S}, CAST(position AS INTEGER) AS position, annual_cents, usage_based, minor_digits
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY current_amount_cents * (CAST(365.25 AS DOUBLE) / period_days) DESC,
                merchant, account_id) AS position FROM costed)
        WHERE position BETWEEN 4 AND 13"""),
    "filtered_subscriptions": q(f"""SELECT {S}, annual_cents, status FROM costed
        WHERE status = 'active' AND annual_cents >= 5000 * pow(10, minor_digits)"""),
    "upcoming_charges": q("""
        SELECT user_id, next_due, merchant, account_id, current_amount_cents, currency, cadence
        FROM subs JOIN as_of USING (user_id) WHERE status = 'active' AND next_due <= as_of + 45"""),
    "upcoming_totals": q("""
        SELECT user_id, currency, count(*) AS charges,
               CAST(sum(current_amount_cents) AS BIGINT) AS total_cents
        FROM subs JOIN as_of USING (user_id) WHERE status = 'active' AND next_due <= as_of + 400
        GROUP BY user_id, currency"""),
    "price_increases": q(f"""
        SELECT * FROM (SELECT {S}, effective_date, old_amount_cents, new_amount_cents, currency,
          CAST(round_even((new_amount_cents - old_amount_cents) * CAST(365.25 AS DOUBLE)
               / period_days, 0) AS BIGINT) AS annual_impact_cents,
          CAST(row_number() OVER (PARTITION BY user_id ORDER BY effective_date DESC, merchant,
               account_id) AS INTEGER) AS position
          FROM changes JOIN subs USING ({S}))"""),
    "charge_history": q(f"""
        SELECT * FROM (SELECT {S}, posted_date, amount AS amount_cents,
          CAST(row_number() OVER (PARTITION BY {S} ORDER BY posted_date, amount) AS INTEGER)
            AS position FROM charges SEMI JOIN found USING ({S}))"""),
    "review_queue": q("""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id
          ORDER BY txn_count DESC, scrubbed) AS INTEGER) AS position FROM review_items
          WHERE status = 'pending')"""),
    "forgotten_subscriptions": q(f"""
        SELECT {S}, CASE WHEN status = 'active' THEN 'annual renewal ahead'
                 ELSE 'no charge for over a cycle -- cancelled, or a failed card' END AS reason,
               next_due, last_seen, current_amount_cents, currency FROM subs
        WHERE status = 'lapsed' OR (status = 'active' AND cadence IN ('annual', 'semiannual'))"""),
    "data_quality": q("""
        SELECT user_id, transactions, resolved_to_a_merchant,
               round_even(resolved_to_a_merchant / transactions * 1000, 0) / 10 AS resolved_pct,
               merchants, coalesce(awaiting, 0) AS awaiting_human_review
        FROM (SELECT user_id, count(*) AS transactions,
                     count(*) FILTER (WHERE amount_cents % 3 <> 0) AS resolved_to_a_merchant,
                     count(DISTINCT merchant) FILTER (WHERE amount_cents % 3 <> 0) AS merchants
              FROM order_txns GROUP BY user_id)
        LEFT JOIN (SELECT user_id, count(*) AS awaiting FROM review_items
                   WHERE status = 'pending' GROUP BY user_id) USING (user_id)"""),
    "frequent_merchants": q("""
        SELECT user_id, account_id, scrubbed, charges, total_cents FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, account_id
                   ORDER BY charges DESC, total_cents, scrubbed) AS rn FROM (
            SELECT user_id, account_id, merchant AS scrubbed, count(*) AS charges,
                   CAST(sum(amount_cents) AS BIGINT) AS total_cents
            FROM part_event_txns WHERE amount_cents < 0 GROUP BY ALL)) WHERE rn <= 15"""),
    "variant_groups": q("""
        WITH v AS (SELECT user_id, split_part(merchant, ' ', 1) AS merchant, merchant AS scrubbed,
                          count(*) AS variant_charges FROM part_txns GROUP BY ALL)
        SELECT * FROM (SELECT *, count(*) OVER w AS variants,
                 CAST(sum(variant_charges) OVER w AS BIGINT) AS charges FROM v
                 WINDOW w AS (PARTITION BY user_id, merchant)) WHERE variants > 1"""),
    "understated_totals": q("""SELECT user_id, count(*) AS descriptors,
        CAST(sum(txn_count) AS BIGINT) AS charges FROM review_items
        WHERE status = 'pending' GROUP BY user_id"""),
    "detected_totals": q("""SELECT user_id, currency, CAST(round_even(sum(CAST(
        current_amount_cents * (CAST(365.25 AS DOUBLE) / period_days) AS DECIMAL(28, 6))), 0)
        AS BIGINT) AS annual_cents
        FROM subs WHERE status = 'active' GROUP BY ALL"""),
    "cost_shares": q(f"""SELECT {S}, currency, annual_cents, round(annual_cents
        / greatest(max(annual_cents) OVER (PARTITION BY user_id, currency), 1), 6) AS cost_share
        FROM costed"""),
    "displayed_amounts": q(f"""
        SELECT {S}, status, CASE minor_digits WHEN 0 THEN format('{{:,}}', current_amount_cents)
            WHEN 2 THEN format('{{:,}}', current_amount_cents // 100) || '.'
                 || lpad(CAST(current_amount_cents % 100 AS VARCHAR), 2, '0')
            ELSE format('{{:,}}', current_amount_cents // 1000) || '.'
                 || lpad(CAST(current_amount_cents % 1000 AS VARCHAR), 3, '0') END
            || ' ' || currency AS amount,
          CASE minor_digits WHEN 0 THEN format('{{:,}}', annual_cents)
            WHEN 2 THEN format('{{:,}}', annual_cents // 100) || '.'
                 || lpad(CAST(annual_cents % 100 AS VARCHAR), 2, '0')
            ELSE format('{{:,}}', annual_cents // 1000) || '.'
                 || lpad(CAST(annual_cents % 1000 AS VARCHAR), 3, '0') END
            || ' ' || currency AS per_year FROM costed"""),
    "mixed_currency_series": q(f"""SELECT {S}, min(currency) AS first_currency,
        max(currency) AS last_currency FROM charges GROUP BY {S}
        HAVING count(DISTINCT currency) > 1"""),
    "load_report": q(_LADDER.replace("FROM part_txns", "FROM event_txns") + """
        SELECT r.*, CAST(coalesce("exact", 0) AS BIGINT) AS "exact",
               CAST(coalesce(fuzzy, 0) AS BIGINT) AS fuzzy, CAST(coalesce(new, 0) AS BIGINT) AS new,
               CAST(coalesce(queued, 0) AS BIGINT) AS queued,
               coalesce(found, 0) AS subscriptions_found FROM (
        SELECT user_id, source_file, rows_read, rows_skipped, coalesce(new, 0) AS rows_new,
               rows_read - coalesce(new, 0) AS rows_duplicate, sign_flipped,
               CAST(0 AS BIGINT) AS empty_names
        FROM event_facts LEFT JOIN (
          SELECT user_id, source_file, count(*) AS new FROM (
            SELECT user_id, account_id, posted_date, amount_cents, raw_descriptor, occ,
                   min(source_file) AS source_file FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id, source_file, account_id,
                       posted_date, amount_cents, raw_descriptor) AS occ FROM event_signed)
            GROUP BY ALL) GROUP BY ALL) USING (user_id, source_file)
        WHERE rows_read > 0) r
        LEFT JOIN (SELECT user_id, sum(n) FILTER (WHERE tier = 'exact') AS "exact",
                          sum(n) FILTER (WHERE tier = 'fuzzy') AS fuzzy,
                          sum(n) FILTER (WHERE tier = 'new') AS new,
                          sum(n) FILTER (WHERE tier = 'queued') AS queued
                   FROM outcomes GROUP BY user_id) USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS found FROM subs GROUP BY user_id)
             USING (user_id)"""),
    "named_reports": q(f"""
        SELECT 'list_subscriptions' AS report, user_id, merchant || '|' || account_id AS item,
               CAST(annual_cents AS DOUBLE) AS amount, next_due AS day, cadence AS note
        FROM costed WHERE status = 'active'
        UNION ALL SELECT 'spending_summary', user_id, currency,
               round(annual_minor / pow(10, minor_digits), 3), as_of,
               CAST(active_count AS VARCHAR) FROM summary
        UNION ALL SELECT 'upcoming_charges', user_id, merchant || '|' || account_id,
               CAST(current_amount_cents AS DOUBLE), next_due, currency
        FROM subs JOIN as_of USING (user_id) WHERE status = 'active' AND next_due <= as_of + 9999
        UNION ALL SELECT 'price_increases', user_id, merchant || '|' || account_id,
               round_even((new_amount_cents - old_amount_cents) * CAST(365.25 AS DOUBLE)
                          / period_days, 0), effective_date,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY effective_date DESC, merchant,
                    account_id) AS VARCHAR) FROM changes JOIN subs USING ({S})
        UNION ALL SELECT 'find_forgotten', user_id, merchant || '|' || account_id,
               CAST(current_amount_cents AS DOUBLE), last_seen,
               CASE WHEN status = 'active' THEN 'annual renewal ahead'
                    ELSE 'no charge for over a cycle -- cancelled, or a failed card' END
        FROM subs WHERE status = 'lapsed' OR (
            status = 'active' AND cadence IN ('annual', 'semiannual'))
        UNION ALL SELECT 'data_quality', user_id, NULL, 100.0, NULL,
               CAST(count(DISTINCT merchant) AS VARCHAR) FROM part_txns GROUP BY user_id"""),
    "detector_scores": q("""
        SELECT *, round(p, 6) AS precision, round(r, 6) AS recall,
               round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1,
               round(CASE WHEN tp = 0 THEN 0 ELSE cadence_right / tp END, 6) AS cadence_accuracy
        FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
                     CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r
              FROM (SELECT count(*) FILTER (WHERE outcome = 'TP') AS tp,
                           count(*) FILTER (WHERE outcome = 'TN') AS tn,
                           count(*) FILTER (WHERE outcome = 'FP') AS fp,
                           count(*) FILTER (WHERE outcome = 'FN') AS fn,
                           count(*) FILTER (WHERE outcome = 'TP' AND NOT wrong_cadence)
                             AS cadence_right FROM judged))""".replace(
        "SELECT *, round(p, 6)", "SELECT * EXCLUDE (p, r), round(p, 6)")),
    "detector_errors": q("SELECT * FROM judged WHERE outcome IN ('FP', 'FN') OR wrong_cadence",
                         cv="plain_cv"),
    "pattern_truth": q("""
        SELECT DISTINCT user_id, merchant,
               CASE WHEN regexp_matches(merchant, '^RED') THEN 'weekly'
                    WHEN regexp_matches(merchant, 'RING') THEN 'monthly'
                    WHEN regexp_matches(merchant, '^COLD .*SMALL$') THEN 'annual'
                    WHEN regexp_matches(merchant, 'SMALL') THEN 'quarterly' END AS expected
        FROM part_txns"""),
    "trailing_attempts": q("""
        SELECT a.kind, a.key, a.event_id, count(b.event_id) - 1 AS recent,
               count(b.event_id) - 1 >= any_value(lim) AS flagged
        FROM attempt_log a JOIN attempt_limits USING (kind)
        JOIN attempt_log b ON a.kind = b.kind AND a.key = b.key AND b.us <= a.us
             AND b.us > a.us - CAST(secs AS BIGINT) * 1000000
        GROUP BY a.kind, a.key, a.event_id
        UNION ALL SELECT kind, key, event_id, NULL, false FROM attempt_log
        WHERE kind NOT IN (SELECT kind FROM attempt_limits)"""),
    "accepted_attempts": q("""
        SELECT kind, key, r.e AS event_id, r.ok AS accepted FROM (
          SELECT kind, key, unnest(list_reduce(l, lambda acc, x:
            CASE WHEN len(list_filter(acc.times, lambda t: t > x.us - x.w)) >= x.lim
                 THEN {'times': list_filter(acc.times, lambda t: t > x.us - x.w),
                       'res': list_append(acc.res, {'e': x.e, 'ok': false})}
                 ELSE {'times': CASE WHEN x.cleared THEN []::BIGINT[] ELSE list_append(
                         list_filter(acc.times, lambda t: t > x.us - x.w), x.us) END,
                       'res': list_append(acc.res, {'e': x.e, 'ok': true})} END,
            {'times': []::BIGINT[], 'res': []::STRUCT(e BIGINT, ok BOOLEAN)[]}).res) AS r
          FROM (SELECT kind, key, list({'us': us, 'w': CAST(secs AS BIGINT) * 1000000,
                         'lim': lim, 'cleared': cleared, 'e': event_id}
                         ORDER BY us, cleared, event_id) AS l
                FROM attempt_log JOIN attempt_limits USING (kind) GROUP BY kind, key))
        UNION ALL SELECT kind, key, event_id, true FROM attempt_log
        WHERE kind NOT IN (SELECT kind FROM attempt_limits)"""),
}
