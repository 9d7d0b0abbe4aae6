"""Benchmark decontamination, in built-in expressions only.

The benchmark's windows of words are few and are counted: up to ``WINDOWS`` of them
their hashes become a set that every task holds, and each text is scanned once, window
by window, inside its row; rows are made only of the windows that hit the set. Hits
are then verified on the words themselves by a join with the windows. A larger benchmark
is joined by hash instead, window by window, shuffled. Hits of one text are counted
once however often windows overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import materialise, unused

WORDS = 13
SHARE = 20              # contaminated from a twentieth of the words on
WINDOWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words are all ASCII characters but digits and letters, A-Z being lower-cased
#: before; so letters of either case are words in the text as it is given.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words in order, as given; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def plain(words: Column, at, length) -> Column:
    """A window's words in lower case (A-Z), joined by spaces."""
    return F.translate(F.array_join(F.slice(words, at, length), " "), UPPER, LOWER)


def window_hash(folded: Column, at, length) -> Column:
    return F.xxhash64(F.slice(folded, at, length))


def starts(words: Column, length) -> Column:
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(1), n - F.lit(length) + 1)).otherwise(
        F.array().cast("array<int>"))


def windows(benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """(length, hash, window, items) of each distinct window; items are ids as text, ''
    for a missing one. An item of fewer than n words is one window, one without words
    none. The hash is of the words in full lower case, which windows that are equal in
    A-Z lower case share."""
    items = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                              words_of(F.col("text")).alias("words"))
             .filter(F.size("words") > 0)
             .withColumn("length", F.least(F.size("words"), F.lit(n)))
             .withColumn("folded", F.transform("words", F.lower)))
    each = items.select("item", "words", "folded", "length",
                        F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1))
                        .alias("at"))
    return (each.groupBy("length", window_hash(F.col("folded"), F.col("at"), F.col("length"))
                         .alias("hash"),
                         plain(F.col("words"), F.col("at"), F.col("length")).alias("window"))
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WORDS,
         limit: int = WINDOWS) -> DataFrame:
    """One row for each row of `docs` and verified window in it: _row, doc_id, text_key,
    n_words, at (from 1), length, items; one row with null `at` for a text without any."""
    known = materialise(windows(benchmark, n))
    few = known.count() <= limit
    lengths = [r[0] for r in known.select("length").distinct().orderBy("length").collect()]
    scanned = (docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                           F.monotonically_increasing_id().alias("_row"),
                           words_of(F.col("text")).alias("words"))
               .withColumn("folded", F.transform("words", F.lower)))
    none = F.array().cast("array<struct<at:int,length:int,window:string>>")
    if few:
        sets = {x: [r[0] for r in known.filter(F.col("length") == x).select("hash").collect()]
                for x in lengths}

        def found(length):
            inside = F.filter(starts(F.col("folded"), length), lambda i: window_hash(
                F.col("folded"), i, F.lit(length)).isin(sets[length]))
            return F.transform(inside, lambda i: F.struct(
                i.alias("at"), F.lit(length).alias("length"),
                plain(F.col("words"), i, F.lit(length)).alias("window")))

        own = scanned.withColumn("hit", F.concat(none, *[found(x) for x in lengths]))
        known = F.broadcast(known)
        each = own.select("_row", "doc_id", "text_key", F.size("words").alias("n_words"),
                          F.explode_outer("hit").alias("hit")).select(
            "_row", "doc_id", "text_key", "n_words", "hit.at", "hit.length", "hit.window")
        marked = each.join(known.select("length", "window", "items"), ["length", "window"], "left")
        return marked.withColumn("at", F.when(F.col("items").isNotNull(), F.col("at")))

    def marked(length):
        return F.transform(starts(F.col("folded"), length), lambda i: F.struct(
            i.alias("at"), F.lit(length).alias("length"),
            window_hash(F.col("folded"), i, F.lit(length)).alias("hash")))

    scanned = materialise(scanned)
    each = scanned.select("_row", F.explode(F.concat(*[marked(x) for x in lengths])).alias("w")
                          ).select("_row", "w.at", "w.length", "w.hash")
    maybe = each.join(known.select("length", "hash").distinct(), ["length", "hash"], "left_semi")
    exact = (maybe.join(scanned.select("_row", "words"), "_row")
             .withColumn("window", plain(F.col("words"), F.col("at"), F.col("length")))
             .join(known.select("length", "window", "items"), ["length", "window"])
             .select("_row", "at", "length", "items"))
    return scanned.select("_row", "doc_id", "text_key", F.size("words").alias("n_words")).join(
        exact, "_row", "left")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, share: int = SHARE,
                  limit: int = WINDOWS) -> DataFrame:
    """For each row of `docs`: doc_id, text_key, n_words, n_hit (words inside any window
    of the benchmark), n_items and items (ids, as sorted texts, with a window in it),
    hit_at (the hit words' positions from 1), contaminated (at least a 1/share of the
    words is hit, and one word). Null and wordless texts have no words and are clean;
    equal rows each give a row; an empty benchmark hits nothing."""
    spans = F.transform(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "length"))),
                        lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))
    counted = hits(docs, benchmark, n, limit).groupBy("_row", "doc_id", "text_key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(spans))).alias("hit_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    n_hit = F.size("hit_at").cast("long")
    return counted.select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_at",
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS,
                      share: int = SHARE) -> DataFrame:
    """`docs` without the rows whose text is contaminated."""
    out_id, out_key = unused(docs, "_out_id", "_out_key")
    out = contamination(docs, benchmark, n, share).filter("contaminated").select(
        F.col("doc_id").alias(out_id), F.col("text_key").alias(out_key)).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(F.col(out_id))
                     & (F.xxhash64("text") == F.col(out_key)), "left_anti")


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """`docs` with the hit words, and what separates each from the next word, cut out of
    `text`; texts without a hit stay as they are."""
    own_id, key, hit_at = unused(docs, "_id", "_key", "hit_at")
    out = contamination(docs, benchmark, n).filter("n_hit > 0").select(
        F.col("doc_id").alias(own_id), F.col("text_key").alias(key),
        F.col("hit_at").alias(hit_at)).dropDuplicates([own_id, key])
    between = BETWEEN[:-1]
    part = F.lit(f"[^{between[1:]}+{between}*")
    parts = F.regexp_extract_all("text", part, F.lit(0))
    kept = F.concat(F.regexp_extract("text", f"^{between}*", 0), F.array_join(
        F.filter(parts, lambda x, i: ~F.array_contains(hit_at, i + 1)), ""))
    both = docs.join(out, docs["doc_id"].eqNullSafe(F.col(own_id))
                     & (F.xxhash64("text") == F.col(key)), "left")
    return both.withColumn("text", F.when(F.col(hit_at).isNotNull(), kept).otherwise(
        F.col("text"))).select(*[docs[c] if c != "text" else F.col("text") for c in docs.columns])
