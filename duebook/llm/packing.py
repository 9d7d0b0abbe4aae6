"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokenising: texts are cut into the tokenizer's pre-tokens, and each distinct pre-token is
encoded once and kept in a bounded table; texts with characters outside the plain Latin
range go to the tokenizer whole.

Packing is hierarchical: each partition packs its own pieces by best fit, longest first.
Bins with less than ``SLACK`` tokens free are done. The others are the items of the next
round, in which `FAN_IN` partitions are merged, until one is left. After a round a
partition has at most one bin that is not over half full, and only such bins can still
move; so it passes on that one and its emptiest others, one for each bin that could
come, which bounds what meets in a task. Each round is written, so that a lost executor
cannot pack a partition a second, different way.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import bounded_batches, give_back, materialise
from duebook.llm.words import slices

CAPACITY = 1024
END = 2
SLACK = 16
FAN_IN = 8
TABLE = 300_000         # pre-tokens a worker remembers, in two halves
CHUNK = 2 ** 16         # bytes of text cut into pre-tokens at once

#: Letters of the plain range, all of category L.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(f"[\t-\r -~{LETTER}]*")
#: The byte-level pre-tokenizer's published pattern, for texts of that range.
PRETOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?+[{LETTER}]++| ?+[0-9]++| ?+[^\t-\r {LETTER}0-9]++"
    "|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Byte-level vocabularies write a byte as a character: printable ones as themselves, the
#: others in order from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in PRINTED]
LETTERS = np.array([b if b in PRINTED else 256 + OTHERS.index(b) for b in range(256)], dtype="<u2")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens. They hold no zero byte, so that byte divides them while all are
        put into the vocabulary's letters at once."""
        laid = np.frombuffer("\0".join(words).encode(), dtype=np.uint8)
        printed = LETTERS[laid].tobytes().decode("utf-16-le").split(chr(LETTERS[0]))
        tokenize = self.model.tokenize
        codes = [[t.id for t in tokenize(word)] for word in printed]
        ends = (4 * np.cumsum([len(c) for c in codes])).tolist()
        laid = np.array(list(chain.from_iterable(codes)), dtype="<u4").tobytes()
        self.table.update(zip(words, [laid[a:b] for a, b in zip([0, *ends], ends)]))

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as pre-tokens; new ones are learnt together."""
        if len(self.table) > TABLE // 2:        # those met again pass on to the next table
            self.older, self.table = self.table, {}
        table, older = self.table, self.older
        found = [list(map(table.get, words)) for words in texts]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        new = []
        for word in {words[i] for words, at in zip(texts, gaps) for i in at}:
            if (ids := older.get(word)) is None:
                new.append(word)
            else:
                table[word] = ids
        if new:
            self.learn(new)
        for words, ids, at in zip(texts, found, gaps):
            for i in at:
                ids[i] = table[words[i]]
        return list(map(b"".join, found))

    def forget(self) -> None:
        """Pre-tokens are learnt anew for each task: kept, they take memory from later stages."""
        self.table, self.older = {}, {}
        give_back()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids,
                        dtype="<u4").tobytes()

    def long(self, text: str) -> bytes:
        found, out = PRETOKEN.finditer(text), []
        while part := [m.group() for m in islice(found, 100_000)]:
            out += self.joined([part])
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """In order; a text is held in pre-tokens only with its neighbours."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size == 0 or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            part = texts[at:to]
            plain = [bool(PLAIN.fullmatch(t)) for t in part]
            if to - at == 1 and size > CHUNK and plain[0]:
                yield self.long(part[0])
            else:
                cut = iter(self.joined([PRETOKEN.findall(t) for t, p in zip(part, plain) if p]))
                for text, is_plain in zip(part, plain):
                    yield next(cut) if is_plain else self.whole(text)
            at = to


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
           end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's token ids and then `end`, cut where it is longer than `capacity`:
    doc_id, piece, start, length, ids_crc32 and, if asked, ids. All pieces but the first
    are full. A null or empty text is `end` alone. Equal rows each give their pieces."""
    path = tokenizer or default_tokenizer()
    schema = PIECE + (", ids binary" if with_ids else "")

    def run(batches):
        stop = np.array([end], dtype="<u4").tobytes()
        for batch, texts in slices(batches):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            texts = [t.decode() for t in texts]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(texts)):
                ids += stop
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                for k, to in enumerate(range(first, n + 1, capacity)):
                    at = max(0, to - capacity) if k else 0
                    part = ids[4 * at:4 * to]
                    for name, value in zip(out, (doc_id, k, at, to - at, zlib.crc32(part),
                                                 part if with_ids else None)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[n], t) for n, t in (
                    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int32()), ("ids_crc32", pa.int64()))]
                + [pa.array(out["ids"], pa.binary())] * with_ids, list(out)[:5 + with_ids])
        encoder(path).forget()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ----------------------------------------------------------------- packing --
def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest first, each into the fullest bin that still takes it: the bin of each
    item, and the bins' lengths. Bins are kept by free space, and a bit mask tells which
    amounts of free space there are."""
    bin_of = np.empty(len(lengths), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            own, free = len(filled), capacity
            filled.append(0)
        bin_of[i] = own
        filled[own] += length
        left = free - length
        by_free[left].append(own)
        mask |= 1 << left
    return bin_of, np.array(filled, dtype=np.int64)


ITEM = ("doc_id long, piece int, start long, length int, ids_crc32 long, offset long")
ITEMS = f"items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"


def merged(items: pa.ListArray, order: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    """Lists i = order[cuts[k]:cuts[k + 1]] one behind the other as list k, each item's
    offset being the sum of the lengths before it."""
    taken = items.take(pa.array(order))
    ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(taken)))])
    values = taken.flatten()
    length = np.asarray(values.field("length")).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(length)])
    bounds = ends[cuts]
    start = np.repeat(before[bounds[:-1]], np.diff(bounds))
    names = [f.split()[0] for f in ITEM.split(", ")]
    new = pa.StructArray.from_arrays(
        [*[values.field(n) for n in names[:-1]], pa.array(before[:-1] - start)], names)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), new)


def pack_round(bins: DataFrame, level: int, parts: int, capacity: int) -> DataFrame:
    """(sequence_id, length, done, items) after one round of best fit in each partition."""
    def run(batches):
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        bin_of, filled = best_fit(table["length"].to_numpy(), capacity)
        done = capacity - filled < SLACK
        half = 2 * filled <= capacity
        open_ = np.flatnonzero(~done & ~half)
        done[open_[np.argsort(filled[open_], kind="stable")][max(64, parts):]] = True
        if parts == 1:
            done[:] = True
        order = np.argsort(bin_of, kind="stable")
        cuts = np.searchsorted(bin_of[order], np.arange(len(filled) + 1))
        items = merged(table["items"].combine_chunks(), order, cuts)
        first = level << 56 | TaskContext.get().partitionId() << 32
        for at in range(0, len(filled), 10_000):
            to = min(at + 10_000, len(filled))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + np.arange(at, to)), pa.array(filled[at:to].astype(np.int32)),
                 pa.array(done[at:to]), items.slice(at, to - at)],
                ["sequence_id", "length", "done", "items"])

    return bins.select("length", "items").mapInArrow(
        run, f"sequence_id long, length int, done boolean, {ITEMS}")


def pack(cut: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """`cut` (rows as `pieces` gives them, none longer than `capacity`) with sequence_id
    and offset: each sequence's pieces lie one behind the other from 0 on. Full pieces
    are sequences by themselves. No rows give no rows."""
    cut = materialise(cut.select("doc_id", "piece", "start", "length", "ids_crc32"))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32",
                    F.lit(0).cast("long").alias("offset"))
    short = cut.filter(F.col("length") < capacity).select("length", F.array(item).alias("items"))
    parts = partitions or max(1, short.rdd.getNumPartitions())
    if partitions:
        short = short.repartition(partitions)
    level, closed = 0, []
    while True:
        made = materialise(pack_round(short, level, parts, capacity))
        closed.append(made.filter("done").select("sequence_id", "items"))
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
        short = made.filter("not done").select("length", "items").coalesce(parts)
        parts = max(1, min(parts, short.rdd.getNumPartitions()))
        level += 1
    packed = closed[0]
    for more in closed[1:]:
        packed = packed.union(more)
    full = cut.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return (packed.select("sequence_id", F.explode("items").alias("item"))
            .select("item.doc_id", "item.piece", "item.start", "item.length", "item.ids_crc32",
                    "sequence_id", "item.offset")
            .union(full).withColumn("length", F.col("length").cast("long")))
