"""Line dedup: lines that several documents share are dropped by probing a sharded
minimal perfect hash.

One pass over the texts counts, for each line's 128-bit hash, the documents that hold
it and the largest of their ids. The hashes with enough documents are dealt over shards
of bounded size, and each shard is made into a minimal perfect hash (levels of bit
arrays, each taking the keys that fall alone on a bit; Limasset et al., 2017) that
numbers its keys, next to arrays of fingerprints, counts and keepers in that numbering.
A second pass probes the arrays with each document's lines; lines are never joined.

While all arrays fit ``BROADCAST_BYTES`` every task gets them. Beyond that, the lines'
hashes (not their texts) are sent to the shards, salted so that a shard's probes are
spread, and each document gets the numbers of its dropped lines back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import SPACE, append_columns, materialise, text_bytes, unused

LETTERS = 20            # code points of the shortest line that may go
DOCUMENTS = 3           # documents a line must be found in to go
SHARD_KEYS = 2 ** 18
BROADCAST_BYTES = 64 * 2 ** 20
PROBES = 2_000_000      # probes of a shard that one task takes
LOAD = 0.5              # keys for each bit of a level
NO_ID = -2 ** 63        # stands for a missing doc_id: below every other


# ---------------------------------------------------------- perfect hashing --
def mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A new hash of the key (a, b) for each level."""
    x = a + b * np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & 2 ** 64 - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Numbers n distinct keys 0..n-1; any other key gets some number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(x), dtype=np.int64)])
                for x in levels]
        before = np.cumsum([0, *[int(x[-1]) for x in ones]])
        self.ranks = [x + at for x, at in zip(ones, before)]

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            if len(levels) == 64:
                raise ValueError("keys are not distinct")
            bits = max(64, int(len(a) / LOAD) + 63 & ~63)
            at = (mixed(a, b, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = mixed(a[left], b[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out


SHARD_SCHEMA = ("shard int, bits array<binary>, prints binary, counts binary, keepers binary")


def shard_row(shard: int, a, b, documents, keepers) -> dict:
    """A shard as bytes: the levels' bits, and the arrays in the hash's numbering."""
    index = PerfectHash.of(a, b)
    order = np.empty(len(a), dtype=np.int64)
    order[index.numbers(a, b)] = np.arange(len(a))
    return {"shard": shard, "bits": [x.tobytes() for x in index.levels],
            "prints": b[order].tobytes(), "counts": documents[order].tobytes(),
            "keepers": keepers[order].tobytes()}


class Shard:
    def __init__(self, row):
        self.index = PerfectHash([np.frombuffer(x, np.uint64) for x in row["bits"]])
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.keepers = np.frombuffer(row["keepers"], np.int64)

    def keeper(self, a: np.ndarray, b: np.ndarray, documents: int) -> tuple:
        """Which keys are lines of at least so many documents, and who keeps them."""
        at = self.index.numbers(a, b)
        known = at >= 0
        known[known] = self.prints[at[known]] == b[known]
        known[known] = self.counts[at[known]] >= documents
        return known, self.keepers[np.where(known, at, 0)] if len(self.prints) else at


# ------------------------------------------------------------------- lines --
def keys_of(text: bytes, letters: int = LETTERS) -> tuple[list[int], bytes]:
    """Line numbers and 16-byte hashes of a text's lines that are long enough."""
    numbers, hashes = [], []
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= letters:
            key = line.strip(SPACE)
            if len(key) >= letters and (key.isascii() or len(key.decode()) >= letters):
                numbers.append(i)
                hashes.append(xxhash.xxh3_128_digest(key.lower()))
    return numbers, b"".join(hashes)


def halves(hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(hashes, np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def line_counts(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(a, b, documents, keeper) of each line hash. Rows of one doc_id are one document;
    so are all rows without doc_id, as a document before all others."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            hashes, owners = [], []
            for doc_id, text in zip(ids, text_bytes(batch)):
                own = np.unique(np.frombuffer(keys_of(text, letters)[1], "V16"))
                hashes.append(own.tobytes())
                owners.append(np.full(len(own), NO_ID if doc_id is None else doc_id))
            a, b = halves(b"".join(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                 pa.array(np.concatenate(owners).astype(np.int64))], ["a", "b", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "a long, b long, doc_id long")
    return rows.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("documents"),
                                      F.max("doc_id").alias("keeper"))


def line_index(docs: DataFrame, letters: int = LETTERS, documents: int = DOCUMENTS) -> tuple:
    """The shards, written, and their number. Lines of fewer documents could never be
    dropped; a probe for one finds no equal fingerprint."""
    kept = materialise(line_counts(docs, letters).filter(F.col("documents") >= documents))
    n = kept.count()
    shards = max(1, -(-n // SHARD_KEYS))

    def build(key, pdf):
        return pd.DataFrame([shard_row(
            int(key[0]), pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64),
            pdf["documents"].to_numpy(), pdf["keeper"].to_numpy())])

    made = (kept.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
            .groupBy("shard").applyInPandas(build, SHARD_SCHEMA))
    return materialise(made), shards


def missing(batch: pa.RecordBatch) -> list[bool]:
    return batch.column(batch.schema.get_field_index("text")).is_null().to_pylist()


def stay(text: bytes, dropped: np.ndarray) -> bytes:
    lines = text.split(b"\n")
    gone = set(dropped.tolist())
    return b"\n".join([x for i, x in enumerate(lines) if i not in gone])


def dedup_lines(docs: DataFrame, letters: int = LETTERS, documents: int = DOCUMENTS,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with its lines deduplicated in `text`, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends and in lower case
    (A-Z). Keys of at least `letters` code points that at least `documents` documents
    hold lose all their lines but those in the largest doc_id that holds them. The other
    lines stay as they are, joined by line feeds; if none stays, the text is empty. A
    null text stays null and counts as one empty line. A column n_chars, if there is
    one, follows the new text."""
    shards, n_shards = line_index(docs, letters, documents)
    size = shards.select(F.sum(F.length("prints") + F.length("counts") + F.length("keepers")
                               + F.aggregate("bits", F.lit(0), lambda s, x: s + F.length(x)))
                         ).first()[0] or 0
    if size <= broadcast_bytes:
        out = probed(docs, shards, n_shards, letters, documents)
    else:
        out = routed(docs, shards, n_shards, letters, documents)
    out = out.withColumn("text", F.col("_kept").cast("string")).drop("_kept")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
                      "n_lines", "n_dropped")


ADDED = "n_lines long, n_dropped long, _kept binary"


def probed(docs, shards, n_shards, letters, documents):
    """Every task probes all shards, which it was sent."""
    sent = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in shards.collect()])
    ready: dict = {}

    def run(batches):
        if not ready:
            ready.update({r["shard"]: Shard(r) for r in sent.value})
        for batch in batches:
            texts, nulls = text_bytes(batch), missing(batch)
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            lines, hashes, ends = [], [], [0]
            for text in texts:
                numbers, own = keys_of(text, letters)
                lines.extend(numbers)
                hashes.append(own)
                ends.append(len(lines))
            a, b = halves(b"".join(hashes))
            numbers = np.array(lines, dtype=np.int64)
            owner = np.repeat(np.array([NO_ID if x is None else x for x in ids], dtype=np.int64),
                              np.diff(ends))
            drop = np.zeros(len(a), dtype=bool)
            home = a.view(np.int64) % n_shards
            for name, shard in ready.items():
                mine = np.flatnonzero(home == name)
                known, keeper = shard.keeper(a[mine], b[mine], documents)
                drop[mine] = known & (keeper != owner[mine])
            kept, n_lines, n_dropped = [], [], []
            for text, null, at, to in zip(texts, nulls, ends, ends[1:]):
                gone = numbers[at:to][drop[at:to]]
                kept.append(None if null else stay(text, gone) if len(gone) else text)
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(len(gone))
            yield [n_lines, n_dropped, kept]

    return append_columns(docs, ADDED, run, consumed=("text",))


def routed(docs, shards, n_shards, letters, documents):
    """The lines' hashes go to the shards, the numbers of dropped lines come back."""
    def hashes(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "_key", "line", "hash")}
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         text_bytes(batch)):
                numbers, own = keys_of(text, letters)
                out["doc_id"] += [doc_id] * len(numbers)
                out["_key"] += [key] * len(numbers)
                out["line"] += numbers
                out["hash"] += [own[i:i + 16] for i in range(0, len(own), 16)]
            a, b = halves(b"".join(out["hash"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["_key"], pa.int64()),
                 pa.array(out["line"], pa.int64()), pa.array(a.view(np.int64)),
                 pa.array(b.view(np.int64))], ["doc_id", "_key", "line", "a", "b"])

    own_id, own_key, own_hash, own_lines = unused(docs, "_id", "_key", "_hash", "_lines")
    key = F.xxhash64("text")
    asked = materialise(docs.select("doc_id", key.alias("_key"), "text").mapInArrow(
        hashes, "doc_id long, _key long, line long, a long, b long"))
    salts = max(1, -(-asked.count() // PROBES))
    asked = (asked.withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int"))
             .withColumn("salt", F.pmod(F.xxhash64("doc_id", "line"), F.lit(salts))))
    copies = shards.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"),
                                                            F.lit(salts - 1).cast("long"))))

    def answer(probes, shard):
        if not len(shard):
            return pd.DataFrame({"doc_id": [], "_key": [], "line": []})
        known, keeper = Shard(shard.iloc[0]).keeper(
            probes["a"].to_numpy().view(np.uint64), probes["b"].to_numpy().view(np.uint64),
            documents)
        owner = probes["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        return probes.loc[known & (keeper != owner), ["doc_id", "_key", "line"]]

    gone = (asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
            .applyInPandas(answer, "doc_id long, _key long, line long")
            .groupBy(F.col("doc_id").alias(own_id), F.col("_key").alias(own_key))
            .agg(F.collect_set("line").alias(own_lines)))
    given = docs.withColumn(own_hash, key)
    both = given.join(gone, given["doc_id"].eqNullSafe(gone[own_id])
                      & (given[own_hash] == gone[own_key]), "left").drop(
                          own_id, own_key, own_hash)

    def run(batches):
        for batch in batches:
            texts, nulls = text_bytes(batch), missing(batch)
            lists = batch.column(batch.schema.get_field_index(own_lines)).to_pylist()
            yield [[t.count(b"\n") + 1 for t in texts], [len(x or ()) for x in lists],
                   [None if null else stay(t, np.array(x)) if x else t
                    for t, null, x in zip(texts, nulls, lists)]]

    return append_columns(both, ADDED, run, consumed=("text", own_lines))
