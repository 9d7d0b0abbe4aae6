"""Near-duplicates by SimHash and word shingles: exactly the pairs whose sets of shingles
have a Jaccard similarity of 0.8 or more and, where asked for, those that ``simhash`` links.

The fingerprints of all texts go through the vantage-point trees of ``simhash``. What they
link within a few bits is counted in full. Neither rule holds the other: texts that repeat
themselves can differ in few bits and yet share few distinct shingles.

Similar pairs may differ in up to a dozen of 64 bits, where a tree no longer prunes, so
those that the trees leave apart are found by an index. Of each distinct set the
first fifth in one order of all shingles is indexed: two sets that are similar enough
share a shingle there, so no pair is missed (prefix filtering; Chaudhuri et al., 2006).
Shingles that a sample of documents shows to be common come last in the order, which
changes the work but not the result. First each set is compared with one leader of each
of its indexed shingles, if the trees have not joined the two; then only sets that share one
and are still in different groups
are compared with each other, as far as the place of the shared shingle in both sets leaves
enough shingles to share (Xiao et al., 2008). The smaller set of such a pair has it in its
first ninth: texts made from one template, whose own shingles come first in the order, do
not meet there. A pair is dropped early if sizes, or parities of shingle counts (a lower
bound of the difference), rule it out, and counted in full otherwise.
Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm import simhash
from duebook.llm.common import components, give_back, materialise
from duebook.llm.words import slices

SHINGLE = 5
LEAST = (4, 5)          # similarity of a link, as a fraction
PARITY = 1024           # bits
SAMPLE = 16             # one text of so many is looked at for common shingles
COMMON = 2 ** 20        # shingles that are put last at most
ROWS = 2 ** 16          # index rows of a batch
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
                              0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - shingle + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        out = (out + hashes[i:i + n]) * MIX[i % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_key(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def parity(own: np.ndarray) -> bytes:
    """For each residue whether an odd number of shingles has it."""
    count = np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits((count & 1).astype(bool)).tobytes()


def needed(n: int) -> int:
    """Shingles that a set at least as similar as LEAST must share with one of n."""
    return -(-LEAST[0] * n // LEAST[1])


def alike(a: int, b: int, common: int) -> bool:
    return LEAST[1] * common >= LEAST[0] * (a + b - common)


def facts(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch, texts in slices(batches):
            sets = [shingles(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_key(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([parity(s) for s in sets], pa.binary())],
                ["doc_id", "text_key", "set_key", "size", "parity"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(
        run, "doc_id long, text_key long, set_key long, size long, parity binary")


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles seen in several texts of the sample, rarer ones first."""
    def run(batches):
        for _, texts in slices(batches):
            for text in texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles(text, shingle).view(np.int64))], ["shingle"])

    found = (docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
             .mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 2")
             .orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas())
    return found["shingle"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def prefixes(docs: DataFrame, shingle: int) -> DataFrame:
    """(shingle, set_key, size, place): the indexed shingles of each distinct set, with their
    places in the set's order; once for each task that meets the set."""
    common = common_shingles(docs, shingle)
    rank = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[rank], rank))

    def run(batches):
        common, rank = sent.value

        def indexed(own):
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                own = own[np.argsort(np.where(common[at] == own, rank[at], -1), kind="stable")]
            return own[:len(own) - needed(len(own)) + 1] if len(own) else own

        def rows(pending):
            n = [len(p[0]) for p in pending]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[0] for p in pending]).view(np.int64)),
                 pa.array(np.repeat([p[1] for p in pending], n).astype(np.int64)),
                 pa.array(np.repeat([p[2] for p in pending], n).astype(np.int32)),
                 pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n]))],
                ["shingle", "set_key", "size", "place"])

        seen: set[int] = set()
        for _, texts in slices(batches):
            pending, held = [], 0
            for text in texts:
                own = shingles(text, shingle)
                key = set_key(own)
                if key in seen:
                    continue
                seen.add(key)
                pending.append((indexed(own), key, len(own)))
                held += len(pending[-1][0])
                if held >= ROWS:
                    yield rows(pending)
                    pending, held = [], 0
            if pending:
                yield rows(pending)

    return docs.select("text").mapInArrow(
        run, "shingle long, set_key long, size int, place int")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of sets that are as similar as LEAST."""
    def possible(batches):
        for batch in batches:
            a, b = (np.asarray(batch.column(i)) for i in (2, 3))
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8)
                        .reshape(-1, PARITY // 8) for i in (4, 5))
            apart = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
            shared = (a + b - apart) // 2
            keep = LEAST[1] * shared >= LEAST[0] * (a + b - shared)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])
        give_back()

    def gathered(batches):
        for batch, texts in slices(batches):
            sets = [shingles(t, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "own"])

    def count(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(alike(len(one), len(two),
                                  len(np.intersect1d(one, two, assume_unique=True))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])
        give_back()

    def side(df, name, *columns):
        return df.select(F.col("set_key").alias(name),
                         *[F.col(c).alias(f"{c}_{name}") for c in columns])

    rough = materialise(
        pairs.join(side(sets, "a", "size", "parity"), "a")
        .join(side(sets, "b", "size", "parity"), "b")
        .select("a", "b", "size_a", "size_b", "parity_a", "parity_b")
        .mapInArrow(possible, "a long, b long"))
    wanted = (rough.select(F.col("a").alias("set_key"))
              .union(rough.select(F.col("b").alias("set_key"))).distinct()
              .join(sets.select("set_key", "text_key"), "set_key").select("text_key"))
    texts = (docs.select(F.xxhash64("text").alias("text_key"), "text")
             .join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
             .select("text").mapInArrow(gathered, "set_key long, own binary"))
    texts = materialise(texts)
    return materialise(
        rough.join(side(texts, "a", "own"), "a").join(side(texts, "b", "own"), "b")
        .select("a", "b", "own_a", "own_b").mapInArrow(count, "a long, b long"))


def tree_pairs(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets to be verified: each set with the least one of its fingerprint, and
    the least ones of fingerprints that the vantage-point trees link; `near` if the fingerprints
    are in fact within simhash.BITS."""
    prints = simhash.fingerprints(docs).select("text_key", "fingerprint").distinct()
    named = materialise(known.select("text_key", "set_key").distinct().join(prints, "text_key")
                        .select("set_key", "fingerprint").distinct())
    leads = materialise(named.groupBy("fingerprint").agg(F.min("set_key").alias("lead")))
    same = named.join(leads, "fingerprint").select("set_key", "lead", F.lit(True))
    near = (simhash.links(leads)
            .join(leads.select(F.col("fingerprint").alias("a"), F.col("lead").alias("one")), "a")
            .join(leads.select(F.col("fingerprint").alias("b"), F.col("lead").alias("two")), "b")
            .select("one", "two", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= simhash.BITS))
    return materialise(same.union(near).toDF("one", "two", "near").filter("one != two")
                       .groupBy(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
                       .agg(F.max("near").alias("near")))


def links(docs: DataFrame, known: DataFrame, sets: DataFrame, shingle: int,
          prints: bool = False) -> DataFrame:
    """Pairs (a, b) of sets whose groups are those of all pairs as similar as LEAST and, with
    `prints`, of all that fingerprints link. Groups go on from step to step as their stars, each
    node with its root: the next joining of groups begins where the last one ended."""
    found = tree_pairs(docs, known)
    tree = found.select("a", "b")
    first = verified(tree, sets, docs, shingle)
    if prints:
        first = first.union(found.filter("near").select("a", "b"))
    joined = materialise(components(first).withColumnRenamed("node", "set_key"))
    # Most shingles belong to one set: one shuffle brings equal ones together, and only those
    # of several sets are written.
    turn = F.struct(F.xxhash64("shingle", "set_key").alias("turn"), "set_key", "size")
    held = Window.partitionBy("shingle")
    index = (prefixes(docs, shingle).repartition("shingle").distinct()
             .withColumn("low", F.min("set_key").over(held))
             .withColumn("high", F.max("set_key").over(held))
             .withColumn("first", F.min(turn).over(held)).filter("low < high"))
    index = materialise(index.select(
        "shingle", "set_key", "size", "place", F.col("first.set_key").alias("lead"),
        F.col("first.size").alias("lead_size")))
    near = (f"{LEAST[1]} * least({{0}}, {{1}}) >= {LEAST[0]} * greatest({{0}}, {{1}})").format
    led = (index.filter("set_key != lead").filter(near("size", "lead_size"))
           .select("set_key", "lead").distinct()
           .join(joined, "set_key", "left")
           .join(joined.toDF("lead", "lead_root"), "lead", "left")
           .filter("coalesce(root, set_key) != coalesce(lead_root, lead)")
           .select(F.least("lead", "set_key").alias("a"), F.greatest("lead", "set_key").alias("b"))
           .distinct().join(tree, ["a", "b"], "left_anti"))
    led = materialise(led)
    tried = tree.union(led)
    roots = materialise(components(joined.toDF("a", "b").union(
        verified(led, sets, docs, shingle))))
    named = index.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "shingle", "set_key", "size", "place", F.coalesce("root", "set_key").alias("root"))
    named = materialise(named)
    split = (named.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .filter("low < high").select("shingle"))
    open_ = materialise(named.join(split, "shingle", "left_semi"))
    small, large = (open_.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in (
        "set_key", "size", "place", "root")]) for s in ("a", "b"))
    both = sum(LEAST)
    # What a set must share with one of its size or more lies from the place on.
    early = f"{both} * (size_a - place_a) >= {2 * LEAST[0]} * size_a"
    enough = (f"{both} * least(size_a - place_a, size_b - place_b) "
              f">= {LEAST[0]} * (size_a + size_b)")
    rest = (small.filter(early).join(large, "shingle")
            .filter("struct(size_a, set_key_a) < struct(size_b, set_key_b)")
            .filter("root_a != root_b").filter(near("size_a", "size_b")).filter(enough)
            .select(F.least("set_key_a", "set_key_b").alias("a"),
                    F.greatest("set_key_a", "set_key_b").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    return roots.toDF("a", "b").union(verified(materialise(rest), sets, docs, shingle))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, prints: bool = False) -> DataFrame:
    """doc_id, text_key, component_id and kept_key of every row of `docs`, as of
    `simhash.near_duplicates`: component_id is the least doc_id that can be reached over texts
    whose shingles are as similar as LEAST or, with `prints`, over those that function links
    as well. Null and blank texts are equal to each other; rows without doc_id get the least
    id of their component, null if it has none."""
    known = materialise(facts(docs, shingle))
    sets = materialise(known.groupBy("set_key").agg(
        simhash.first_row(), F.min("text_key").alias("text_key"),
        F.first("size").alias("size"), F.first("parity").alias("parity")))
    roots = materialise(components(links(docs, known, sets, shingle, prints))
                        .withColumnRenamed("node", "set_key"))
    least = (roots.join(sets.select("set_key", "first"), "set_key").groupBy("root")
             .agg(F.min("first").alias("least")))
    named = (sets.select("set_key", "first").join(roots.join(least, "root"), "set_key", "left")
             .select("set_key", F.coalesce("least", "first").alias("least")))
    return known.join(named, "set_key").select(
        "doc_id", "text_key", F.col("least.doc_id").alias("component_id"),
        F.col("least.text_key").alias("kept_key"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, prints: bool = False) -> DataFrame:
    """`docs` with one row of each group, as `simhash.keep_least`."""
    return simhash.keep_least(docs, materialise(near_duplicates(docs, shingle, prints)))
