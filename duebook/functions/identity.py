"""Row identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedup_key(user_id: Column, account_id: Column, posted_date: Column,
              amount_cents: Column, descriptor: Column, occurrence: Column) -> Column:
    """sha-256 over what makes a charge itself. The account counts by id; its label
    may change."""
    return F.sha2(F.concat_ws("|", *(c.cast("string") for c in (
        user_id, account_id, posted_date, amount_cents, descriptor, occurrence))), 256)
