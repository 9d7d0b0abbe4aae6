"""Merchant resolution: exact alias, then name similarity, then a review queue.

A descriptor that resembles no known merchant becomes one itself, most frequent
first, and is known to all later ones. Names are compared inside tiles: a tenant's
needles and known names are dealt to hash buckets of about two thousand, each pair
of buckets is one Arrow group, and a tile only emits what survives (a flag, or a
needle's best few). No pair of names is ever a row, and a tenant with very many
names is many equal tiles instead of one task. In a tile, bounds from matrix products
(``similarity.Comparison``) leave few pairs to be scored, and lose none that counts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.functions.similarity import (ACCEPT, BORDERLINE, MARGIN, NEEDLES_AT_ONCE,
                                          SHORTEST_HELD, SUSPECT, Comparison)
from duebook.operators.merge import merge_keep_first, merge_update
from duebook.operators.skew import by_python_key, join_list, materialise, per_key_join, top_rows

TILE = 2000
BATCH = 1000
BLOCK = 64
TOKEN_HITS, OTHER_HITS = 5, 3
NAME_CHARS = 200
NEEDLE = ["user_id", "scrubbed"]
TIERS = ("exact", "fuzzy", "new", "queued")


class State(NamedTuple):
    """The tables resolution reads and rewrites."""
    transactions: DataFrame
    merchants: DataFrame
    aliases: DataFrame
    queue: DataFrame


def unresolved_counts(txns: DataFrame) -> DataFrame:
    """Distinct unresolved descriptors with their number of charges."""
    return (txns.filter("merchant is null").groupBy(*NEEDLE)
            .agg(F.count("*").alias("n")))


# ------------------------------------------------------------------ tiles --
def _tiles_needed(names: DataFrame, tile: int, column: str) -> DataFrame:
    return names.groupBy("user_id").agg(
        F.ceil(F.count("*") / tile).cast("int").alias(column),
        F.count("*").alias(f"{column}_rows"))


def _in_tiles(needles: DataFrame, known: DataFrame, body, schema: str, tile: int) -> DataFrame:
    """Run `body(needle frame, known frame)` on every pair of buckets of a tenant."""
    sizes = (_tiles_needed(needles, tile, "_nt")
             .join(_tiles_needed(known, tile, "_kt"), "user_id"))

    def deal(df, text, own, other):
        sized = per_key_join(df, sizes.select("user_id", "_nt", "_kt", f"{own}_rows"),
                             ["user_id"], [text], weight=f"{own}_rows").drop(f"{own}_rows")
        return (sized.withColumn(own, F.pmod(F.xxhash64(text), F.col(own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))))

    key = ["user_id", "_nt", "_kt"]
    left = by_python_key(deal(needles, "scrubbed", "_nt", "_kt"), key).groupBy(*key)
    right = by_python_key(deal(known, "name", "_kt", "_nt"), key).groupBy(*key)
    return left.cogroup(right).applyInPandas(body, schema)


def _flag_related(needles: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    found = Comparison(needles["scrubbed"].tolist(), known["name"].tolist()).flags()
    return needles.loc[found, NEEDLE]


def drop_related(needles: DataFrame, known: DataFrame, tile: int = TILE) -> DataFrame:
    """Needles that resemble no known name at all."""
    flagged = _in_tiles(needles.select(*NEEDLE), known.select("user_id", "name"),
                        _flag_related, "user_id bigint, scrubbed string", tile)
    return needles.join(flagged, NEEDLE, "left_anti")


# --------------------------------------------------------------- founders --
def _found(batch: pd.DataFrame) -> pd.DataFrame:
    """First come, first founded, over one bounded batch in rank order."""
    batch = batch.sort_values(["n", "scrubbed"], ascending=[False, True], kind="stable")
    names = batch["scrubbed"].tolist()
    both = Comparison(names, names)
    chosen: list[int] = []
    for at in range(0, len(names), BLOCK):
        block = np.arange(at, min(at + BLOCK, len(names)))
        maybe = both.candidates(slice(at, at + BLOCK))
        ia, ib = np.nonzero(maybe[:, chosen])
        ia, ib = block[ia], np.array(chosen, dtype=np.int64)[ib]
        block = np.setdiff1d(block, ia[both.related(ia, ib)])
        ia, ib = np.nonzero(np.tril(maybe[np.ix_(block - at, block)], -1))
        ia, ib = block[ia], block[ib]
        close = both.related(ia, ib)
        barred = set()
        earlier: dict[int, list[int]] = {}
        for d, e in zip(ia[close].tolist(), ib[close].tolist()):
            earlier.setdefault(d, []).append(e)
        for d in block.tolist():
            if any(e not in barred for e in earlier.get(d, ())):
                barred.add(d)
            else:
                chosen.append(d)
    return batch.iloc[chosen][[*NEEDLE, "n"]]


def _ranks(*sides: list[tuple]) -> list[np.ndarray]:
    """Places of sort keys in the order of all sides together."""
    at = {key: k for k, key in enumerate(sorted({key for side in sides for key in side}))}
    return [np.array([at[key] for key in side], dtype=np.int64) for side in sides]


def _flag_later(needles: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Needles related to a known name of a smaller rank than their own."""
    left, right = needles["scrubbed"].tolist(), known["name"].tolist()
    mine, theirs = _ranks(list(zip((-needles["n"]).tolist(), left)),
                          list(zip((-known["n"]).tolist(), right)))
    found = Comparison(left, right).flags(lambda rows: theirs[None, :] < mine[rows][:, None])
    return needles.loc[found, NEEDLE]


def found_round(undecided: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """One round for all tenants at once: a name that resembles no undecided name before
    it is a founder whatever becomes of the others. -> (founders, undecided after them)"""
    def after(names, known):
        return materialise(_in_tiles(names, known.toDF("user_id", "name", "n"), _flag_later,
                                     "user_id bigint, scrubbed string", tile).distinct())

    later = after(undecided, undecided)
    new = materialise(undecided.join(later, NEEDLE, "left_anti"))
    rest = materialise(undecided.join(later, NEEDLE, "left_semi"))
    return new, materialise(rest.join(after(rest, new), NEEDLE, "left_anti"))


def select_founders(needles: DataFrame, merchants: DataFrame, batch: int = BATCH,
                    tile: int = TILE) -> DataFrame:
    """Needles (user_id, scrubbed, n) that become merchants, in the order count
    descending, then text.

    Nearly all tenants have fewer distinct names than one batch and finish in one
    pass. The names of larger ones are settled in parallel rounds: who resembles no
    undecided name before it is in, and strikes whatever resembles it. That is the
    sequential rule, in as many rounds as the longest chain of names that each hang on
    the one before; struck and settled names take no part in the next.
    """
    known = merchants.select("user_id", F.col("canonical_name").alias("name"))
    schema = "user_id bigint, scrubbed string, n bigint"
    undecided = drop_related(needles, known, tile)
    oversize = materialise(needles.groupBy("user_id").agg(F.count("*").alias("k"))
                           .filter(F.col("k") > batch).select("user_id"))

    def in_one_pass(df):
        return (by_python_key(df, ["user_id"]).groupBy("user_id").applyInPandas(_found, schema))

    if oversize.isEmpty():
        return in_one_pass(undecided)
    undecided = materialise(undecided)
    found = in_one_pass(join_list(undecided, oversize, ["user_id"], "left_anti"))
    rest = materialise(join_list(undecided, oversize, ["user_id"], "left_semi"))
    while not rest.isEmpty():
        new, rest = found_round(rest, tile)
        found = found.unionByName(new)
    return found


# --------------------------------------------------------------- verdicts --
_HIT = ("user_id bigint, scrubbed string, kind string, name string, score double, "
        "founded boolean, rank_n bigint")


def _best_hits(needles: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Per needle: its best names in this tile, by each score."""
    known = known.sort_values(["founded", "rank_n", "name"], kind="stable")
    left, right = needles["scrubbed"].tolist(), known["name"].tolist()
    rank_n = known["rank_n"].tolist()
    mine, theirs = _ranks(list(zip((-needles["n"]).tolist(), left)), list(zip(rank_n, right)))
    founded, users = known["founded"].to_numpy(dtype=bool), needles["user_id"].tolist()
    both = Comparison(left, right)
    bare = np.array([len(t) for t in both.bare], dtype=np.float32)
    j = np.arange(len(right))[None, :]
    out = []

    def keep(kind, ia, ib, score):
        for a, b, s in zip(ia.tolist(), ib.tolist(), score.tolist()):
            out.append((users[a], left[a], kind, right[b], s, bool(founded[b]), rank_n[b]))

    for at in range(0, len(left), NEEDLES_AT_ONCE):
        rows = np.arange(at, min(at + NEEDLES_AT_ONCE, len(left)))
        common, letters, pairs = both.shared_block(slice(at, at + NEEDLES_AT_ONCE))
        allowed = ~founded[None, :] | (theirs[None, :] < mine[rows][:, None])
        i = rows[:, None]
        bound = np.where(allowed, both.token_bound(common, letters, i, j), -np.inf)
        ia, ib, score = both.best(both.token_set, bound, rows, TOKEN_HITS)
        keep("token", ia, ib, score)
        top = np.zeros(len(rows))
        np.maximum.at(top, ia - at, score)
        k = np.flatnonzero(top < BORDERLINE)
        if not len(k):
            continue
        rows, i = rows[k], rows[k][:, None]
        allowed, letters, pairs = allowed[k], letters[k], pairs[k]
        bound = np.where(allowed, both.partial_bound(letters, pairs, i, j), -np.inf)
        keep("partial", *both.best(both.partial, bound, rows, OTHER_HITS))
        least = np.minimum(bare[i], bare[j + both.shift])
        ia, ib = np.nonzero(allowed & (least >= SHORTEST_HELD) & (letters >= least - 0.5))
        inside = both.held(rows[ia], ib)
        ia, ib = ia[inside], ib[inside]
        first = np.arange(len(ia)) - np.searchsorted(ia, ia) < OTHER_HITS
        ia, ib = rows[ia[first]], ib[first]
        keep("held", ia, ib, both.partial(ia, ib))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _HIT.split(", ")])


def best_hits(needles: DataFrame, known: DataFrame, tile: int = TILE) -> DataFrame:
    """`needles` (user_id, scrubbed, n) against `known` (user_id, name, founded,
    rank_n): the best 5 names by token_set; where that stays below the borderline
    also the best 3 by partial and the first 3 by containment. Founders only count
    for descriptors that come after them."""
    rows = _in_tiles(needles.select(*NEEDLE, "n"), known, _best_hits, _HIT, tile)
    score = F.when(F.col("kind") == "held", 0.0).otherwise(F.col("score"))
    rows = rows.withColumn("_by", score)
    best = top_rows(rows, [*NEEDLE, "kind"], [F.desc("_by"), "founded", "rank_n", "name"],
                    TOKEN_HITS)
    hit = F.struct((-F.col("_by")).alias("by"), "founded", "rank_n", "name", "score")

    def hits(kind, limit):
        ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, hit)))
        return F.transform(F.slice(ordered, 1, limit),
                           lambda h: F.struct(h["name"].alias("name"), h["score"].alias("score")))

    return best.groupBy(*NEEDLE).agg(
        hits("token", TOKEN_HITS).alias("token"), hits("partial", OTHER_HITS).alias("partial"),
        hits("held", OTHER_HITS).alias("held"))


def _score(hits: str, i: int) -> Column:
    return F.coalesce(F.get(F.col(hits), i)["score"], F.lit(0.0))


def classify(hits: DataFrame) -> DataFrame:
    """-> (user_id, scrubbed, verdict, candidates). Every verdict but ``match``
    goes to the review queue."""
    top, second = _score("token", 0), _score("token", 1)
    clash = (F.size("token") > 1) & (top - second <= MARGIN) & (second >= BORDERLINE)
    verdict = (F.when(clash, "ambiguous").when(top >= ACCEPT, "match")
               .when(top >= BORDERLINE, "borderline")
               .when(_score("partial", 0) >= SUSPECT, "suspect")
               .when(F.size("held") > 0, "suspect").otherwise("unknown"))
    candidates = (F.when((top >= BORDERLINE), F.col("token"))
                  .when(_score("partial", 0) >= SUSPECT, F.col("partial"))
                  .when(F.size("held") > 0, F.col("held")).otherwise(F.col("token")))
    return hits.select(*NEEDLE, verdict.alias("verdict"), candidates.alias("candidates"))


# -------------------------------------------------------------------- run --
def resolve(state: State, batch: int = BATCH, tile: int = TILE) -> tuple[State, DataFrame]:
    """One resolution run over all tenants -> (new state, outcomes).

    `outcomes` has one row per unresolved descriptor: tier (exact, fuzzy, new or
    queued), merchant, score, verdict, candidates, n. A descriptor already pending
    stays with its human and its queue row is left alone; an ignored one is judged
    again.
    """
    counts = materialise(unresolved_counts(state.transactions))
    alias = state.aliases.select("user_id", F.col("scrubbed_pattern").alias("scrubbed"),
                                 F.col("merchant").alias("_alias"))
    pending = state.queue.filter("status = 'pending'").select(*NEEDLE, F.lit(True).alias("_held"))
    tagged = counts.join(alias, NEEDLE, "left").join(pending, NEEDLE, "left")
    empty = F.lit(None).cast("array<struct<name:string,score:double>>")
    settled = tagged.filter("_alias is not null or _held").select(
        *NEEDLE, "n", F.when(F.col("_alias").isNotNull(), "exact").otherwise("queued").alias("tier"),
        F.col("_alias").alias("merchant"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("verdict"), empty.alias("candidates"))
    needles = materialise(tagged.filter("_alias is null and _held is null").select(*NEEDLE, "n"))
    founders = materialise(select_founders(needles, state.merchants, batch, tile))
    new = founders.select(
        *NEEDLE, "n", F.lit("new").alias("tier"), F.col("scrubbed").alias("merchant"),
        F.lit(None).cast("double").alias("score"), F.lit("unknown").alias("verdict"),
        empty.alias("candidates"))

    existing = state.merchants.select(
        "user_id", F.col("canonical_name").alias("name"), F.lit(False).alias("founded"),
        F.lit(0).cast("bigint").alias("rank_n"))
    founded = founders.select(
        "user_id", F.col("scrubbed").alias("name"), F.lit(True).alias("founded"),
        (-F.col("n")).alias("rank_n")).join(existing.select("user_id", "name"),
                                            ["user_id", "name"], "left_anti")
    others = needles.join(founders.select(*NEEDLE), NEEDLE, "left_anti")
    judged = classify(best_hits(others, existing.unionByName(founded), tile))
    top = F.get("candidates", 0)
    matched = F.col("verdict") == "match"
    fuzzy = others.join(judged, NEEDLE).select(
        *NEEDLE, "n", F.when(matched, "fuzzy").otherwise("queued").alias("tier"),
        F.when(matched, top["name"]).alias("merchant"), top["score"].alias("score"),
        "verdict", "candidates")
    outcomes = materialise(settled.unionByName(new).unionByName(fuzzy))
    return apply_outcomes(state, outcomes), outcomes


def link(txns: DataFrame, links: DataFrame, only_unresolved: bool = True) -> DataFrame:
    """Set the merchant of transactions by descriptor. Links that say how many
    charges a descriptor has (n) get only the hot ones salted."""
    weight = "n" if "n" in links.columns else None
    links = links.select(*NEEDLE, F.col("merchant").alias("_merchant"), *([weight] if weight else []))
    todo = txns.filter("merchant is null") if only_unresolved else txns
    hit = per_key_join(todo, links, NEEDLE, ["dedup_hash"], "left", weight)
    hit = hit.withColumn("merchant", F.coalesce("_merchant", "merchant")).drop("_merchant")
    done = hit.select(*txns.columns)
    return (txns.filter("merchant is not null").unionByName(done)
            if only_unresolved else done)


def apply_outcomes(state: State, outcomes: DataFrame) -> State:
    linked = outcomes.filter("merchant is not null")
    new_merchants = outcomes.filter("tier = 'new'").select(
        "user_id", F.col("merchant").alias("canonical_name"),
        F.lit(None).cast("string").alias("category"))
    new_aliases = outcomes.filter("tier in ('new', 'fuzzy')").select(
        "user_id", F.col("scrubbed").alias("scrubbed_pattern"), "merchant",
        F.when(F.col("tier") == "fuzzy", "fuzzy").otherwise("exact").alias("resolved_by"),
        F.when(F.col("tier") == "fuzzy", F.rint(F.col("score") * 10) / 1000)
        .alias("confidence"))
    asked = outcomes.filter("tier = 'queued' and verdict is not null").select(
        *NEEDLE, F.col("n").alias("txn_count"), "candidates",
        (F.rint(F.col("score") * 100) / 100).alias("top_score"),
        F.col("verdict").alias("reason"), F.lit("pending").alias("status"))
    return State(
        link(state.transactions, linked),
        merge_keep_first(state.merchants, new_merchants, ["user_id", "canonical_name"]),
        merge_keep_first(state.aliases, new_aliases, ["user_id", "scrubbed_pattern"]),
        merge_update(state.queue, asked, NEEDLE, ["txn_count", "candidates", "top_score"]))


def tier_stats(outcomes: DataFrame) -> DataFrame:
    """Transactions per tenant and tier."""
    return outcomes.groupBy("user_id", "tier").agg(F.sum("n").alias("transactions"))


# ----------------------------------------------------------------- review --
def apply_decisions(state: State, decisions: DataFrame, repoint_all: bool = True) -> State:
    """A batch of review answers (user_id, scrubbed, merchant, ignore, decided_at)
    to pending queue items; the last answer to an item counts. A named merchant
    becomes the descriptor's alias for good (an old alias keeps how it was first
    resolved) and every transaction of the descriptor moves to it; with
    ``repoint_all=False`` only the unresolved ones do. A blank name, or one above
    ``NAME_CHARS`` characters, is no answer: the item goes on waiting.
    """
    pending = state.queue.filter("status = 'pending'").select(*NEEDLE)
    last = (decisions.groupBy(*NEEDLE)
            .agg(F.max_by(F.struct("merchant", "ignore"), "decided_at").alias("a"))
            .join(pending, NEEDLE, "left_semi"))
    asked = F.when(F.col("a.merchant") == "", None).otherwise(F.col("a.merchant"))
    name = F.trim(F.coalesce(asked, F.col("scrubbed")))
    ignored = F.coalesce(F.col("a.ignore"), F.lit(False))
    last = last.select(*NEEDLE, ignored.alias("ignored"), F.when(~ignored, name).alias("merchant"))
    last = materialise(last.filter(F.col("ignored") | F.length("merchant").between(
        1, NAME_CHARS)))
    named = last.filter("not ignored")
    status = last.select(*NEEDLE, F.when(F.col("ignored"), "ignored").otherwise("resolved")
                         .alias("_status"))
    queue = (state.queue.join(status, NEEDLE, "left")
             .withColumn("status", F.coalesce("_status", "status")).select(*state.queue.columns))
    aliases = named.select("user_id", F.col("scrubbed").alias("scrubbed_pattern"), "merchant",
                           F.lit("human").alias("resolved_by"),
                           F.lit(None).cast("double").alias("confidence"))
    key = ["user_id", "scrubbed_pattern"]
    return State(
        link(state.transactions, named, only_unresolved=not repoint_all),
        merge_keep_first(state.merchants, named.select(
            "user_id", F.col("merchant").alias("canonical_name"),
            F.lit(None).cast("string").alias("category")), ["user_id", "canonical_name"]),
        merge_update(state.aliases, aliases, key, ["merchant"]) if repoint_all
        else merge_keep_first(state.aliases, aliases, key),
        queue)
