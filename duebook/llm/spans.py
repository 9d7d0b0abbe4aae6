"""Substring dedup: spans of many words that occur earlier are removed, found by suffix
automata of reference shards.

A reference automaton holds every substring of its shard's word sequences, and for each the
place where it ends first. Sequences stream through it for their matching statistics: the
length of the longest suffix at each word that the shard holds, cut back to a window's
length, and that match's first place. A window whose first place is not its own occurs
earlier.

Sending every automaton to every text would cost texts times shards, and automata of a whole
corpus fit no task. So the shards are cut by content: a window's anchor is the least hash
among its runs of 8 words, equal windows have equal anchors, and the consecutive windows
that share an anchor are one fragment of a text. Fragments of equal anchor meet in the shard
of that anchor, each distinct one once, in the order of first occurrence; the shard is at
once the reference and what streams through it.

Two passes over the texts keep what moves small. The first gives a row of numbers for each
fragment, known by its anchor's hash and its own; all of them, so that what moves grows as the
corpus does, however much of it is repeated. Equal fragments need no automaton, as all but the
first are repeated whole; nor does an anchor that has one distinct fragment. Only the words of
the others are sent, by the second, each from its first place. A text then needs to know which
of its fragments are first ones: these come back to it by its id, and all its others are
repeated.

An anchor with more distinct fragments than a shard should hold (a line that many texts
share, each time in other words) has them cut into single windows, which are compared by
their hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm import bitfilter
from duebook.llm.common import append_columns, materialise, text_bytes
from duebook.llm.words import BASE, Texts, slices
from duebook.operators.skew import join_list, key_list

WINDOW = 20
ANCHOR = 8
SHARD_FRAGMENTS = 4096


# -------------------------------------------------------- suffix automaton --
class SuffixAutomaton:
    """All substrings of the sequences added so far, with the place (a running number of
    symbols) where each ends first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.places = 0

    def _state(self, edges: dict, length: int, first: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.first.append(first)
        self.link.append(0)
        return len(self.length) - 1

    def _split(self, at: int, symbol: int, old: int) -> int:
        """The state for the shorter substrings of `old`, one symbol beyond `at`."""
        new = self._state(dict(self.next[old]), self.length[at] + 1, self.first[old])
        self.link[new], self.link[old] = self.link[old], new
        while at >= 0 and self.next[at].get(symbol) == old:
            self.next[at][symbol] = new
            at = self.link[at]
        return new

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            place, self.places = self.places, self.places + 1
            known = self.next[last].get(symbol)
            if known is not None:
                last = (known if self.length[known] == self.length[last] + 1
                        else self._split(last, symbol, known))
                continue
            new = self._state({}, self.length[last] + 1, place)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at >= 0:
                old = self.next[at][symbol]
                self.link[new] = (old if self.length[old] == self.length[at] + 1
                                  else self._split(at, symbol, old))
            last = new

    def statistics(self, sequence, most: int):
        """For each symbol, (length of the longest match that ends there, at most `most`;
        the place where that match ends first)."""
        at = matched = 0
        for symbol in sequence:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if symbol in self.next[at]:
                at = self.next[at][symbol]
                matched += 1
            while at and self.length[self.link[at]] >= most:
                at = self.link[at]
            matched = min(matched, self.length[at], most)
            yield matched, self.first[at]


def repeated(sequences: list[list], window: int) -> list[int]:
    """For each sequence a mask of its windows (bit k: starting at word k) that occur in a
    sequence before it, or earlier in itself."""
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    masks, begin = [], 0
    for s in sequences:
        mask = 0
        for i, (matched, first) in enumerate(automaton.statistics(s, window)):
            if matched >= window and first < begin + i:
                mask |= 1 << i - window + 1
        masks.append(mask)
        begin += len(s)
    return masks


# ---------------------------------------------------------------- fragments --
def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive words: a polynomial, put together from those of
    half the length."""
    def polynomial(n):
        if n == 1:
            return hashes, BASE
        half, power = polynomial(n // 2)
        out = half[:max(0, len(half) - n // 2)] * power + half[n // 2:]
        power = power * power
        if n % 2:
            out = out[:max(0, len(out) - 1)] * BASE + hashes[n - 1:]
            power = power * BASE
        return out, power

    with np.errstate(over="ignore"):
        out, _ = polynomial(length)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` consecutive values lies, the first of equal ones."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(values[a] <= values[b], a, b)
        span += step
    return best


def windows_by_anchor(hashes: np.ndarray, ends: np.ndarray, window: int, anchor: int):
    """Of texts laid end to end (`ends`: where each stops): (text, start, windows, first word
    of all) and the anchor's hash of each run of windows that share an anchor's place."""
    if len(hashes) < window:
        return np.zeros((4, 0), np.int64), np.zeros(0, np.uint64)
    runs = run_hashes(hashes, anchor)
    place = least_places(runs, window - anchor + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:len(place)]
    inside = np.arange(len(place)) + window <= ends[text]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new), len(place))
    size = stop[np.searchsorted(stop, start, side="right")] - start
    # Windows that run over a text's end follow those inside, so only the length changes.
    size = np.minimum(size, ends[text[start]] - window + 1 - start)
    begins = np.concatenate([[0], ends])[text[start]]
    return np.stack([text[start], start - begins, size, start]), runs[place[start]]


FRAGMENTS = "anchor long, print long, doc_id long, key long, start int, n int"
WORDS = "anchor long, print long, text binary"


def fragments(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """A row for each fragment."""
    def run(batches):
        for rows, own in slices(batches):
            texts = Texts(own)
            (text, start, n, first), found = windows_by_anchor(
                texts.hashes, texts.ends, window, anchor)
            prints = list(map(xxhash.xxh3_64_intdigest, texts.words(first, n + (window - 1))))
            ids = rows.select(["doc_id", "key"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)),
                 pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                 ids.column(0).cast(pa.int64()), ids.column(1), pa.array(start.astype(np.int32)),
                 pa.array(n.astype(np.int32))], [f.split()[0] for f in FRAGMENTS.split(", ")])

    return texts.mapInArrow(run, FRAGMENTS)


def place_slots(rows: pa.RecordBatch, start: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the places (doc_id, key, start); `rows` has the first two."""
    doc_id, key = (rows.column(rows.schema.get_field_index(c)).cast(pa.int64()).fill_null(0)
                   .to_numpy(zero_copy_only=False).view(np.uint64) for c in ("doc_id", "key"))
    with np.errstate(over="ignore"):
        mixed = ((doc_id * BASE ^ key) * BASE + start.astype(np.uint64)) * BASE
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return bitfilter.slots(mixed ^ (mixed >> np.uint64(32)), bits)


def fragment_words(texts: DataFrame, wanted: DataFrame, window: int, anchor: int, bits: int
                   ) -> DataFrame:
    """The words of the `wanted` fragments (anchor, print, first), from their first places, and
    of some others."""
    def slots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place_slots(
                batch, batch.column(2).to_numpy(zero_copy_only=False), bits))], ["slot"])

    sent = texts.sparkSession.sparkContext.broadcast(bitfilter.collected(
        wanted.select("first.doc_id", "first.key", "first.start").mapInArrow(slots, "slot long"),
        bits))

    def run(batches):
        for rows, own in slices(batches):
            texts = Texts(own)
            (text, start, n, first), found = windows_by_anchor(
                texts.hashes, texts.ends, window, anchor)
            kept = bitfilter.marked(sent.value, place_slots(
                rows.select(["doc_id", "key"]).take(pa.array(text)), start, bits))
            words = texts.words(first[kept], n[kept] + (window - 1))
            prints = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[kept].view(np.int64)), pa.array(prints.view(np.int64)),
                 pa.array(words, pa.binary())], ["anchor", "print", "text"])

    return texts.mapInArrow(run, WORDS)


# -------------------------------------------------------------------- masks --
#: A mask stands at the first place of its fragment.
MASKS = "_known boolean, _id long, _key long, start int, mask long"


def shard_masks(wanted: DataFrame, words: DataFrame, window: int, shard_fragments: int
                ) -> DataFrame:
    """MASKS of the `wanted` fragments of which some window has an earlier place, by the
    automaton of each anchor's shard. `words` may have a fragment repeatedly."""
    shards = max(1, -(-wanted.count() // shard_fragments))
    shard = F.pmod("anchor", F.lit(shards)).alias("shard")

    def run(places, words):
        own = ["anchor", "print"]
        pdf = places.merge(words.drop_duplicates(own), on=own).sort_values(
            ["known", "doc_id", "key", "start"], kind="stable")
        numbers: dict = {}
        sequences = [[numbers.setdefault(w, len(numbers)) for w in text.split(b" ")]
                     for text in pdf["text"]]
        return pd.DataFrame({"_known": pdf["known"], "_id": pdf["doc_id"], "_key": pdf["key"],
                             "start": pdf["start"], "mask": repeated(sequences, window)})

    places = wanted.select("anchor", "print", F.col("first.doc_id").isNotNull().alias("known"),
                           F.coalesce("first.doc_id", F.lit(0)).alias("doc_id"), "first.key",
                           "first.start")
    return (places.groupBy(shard).cogroup(words.groupBy(shard))
            .applyInPandas(run, MASKS).filter("mask != 0"))


def window_masks(distinct: DataFrame, window: int) -> DataFrame:
    """The same for fragments of hot anchors: each window is a row, and the first of equal
    ones is a grouped minimum."""
    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("row", "at", "hash")}
            for row, text in enumerate(batch.column(2).to_pylist()):
                words = text.split(b" ")
                for k in range(len(words) - window + 1):
                    out["row"].append(row)
                    out["at"].append(k)
                    out["hash"].append(xxhash.xxh3_128_digest(b" ".join(words[k:k + window])))
            halves = np.frombuffer(b"".join(out["hash"]), np.int64).reshape(-1, 2)
            rows = batch.select(["anchor", "print", "doc_id", "key", "start"]).take(
                pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(out["at"], pa.int32()),
                 pa.array(np.ascontiguousarray(halves[:, 0])),
                 pa.array(np.ascontiguousarray(halves[:, 1]))],
                ["anchor", "print", "doc_id", "key", "start", "at", "wa", "wb"])

    rows = materialise(
        distinct.select("anchor", "print", "text", "first.doc_id", "first.key", "first.start")
        .mapInArrow(cut, "anchor long, print long, doc_id long, key long, start int, at int, "
                         "wa long, wb long")
        .withColumn("place", F.struct("doc_id", "key", (F.col("start") + F.col("at")).alias("p"))))
    first = rows.groupBy("wa", "wb").agg(F.min("place").alias("earliest"))
    return (rows.join(first, ["wa", "wb"]).filter("place != earliest")
            .groupBy("anchor", "print", *place(F.col("doc_id"), F.col("key")), "start")
            .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
            .select(*[f.split()[0] for f in MASKS.split(", ")]))


def places(rows: DataFrame) -> tuple[Column, Callable[[str], Column]]:
    """A column that orders the rows' places in the corpus, and what gives doc_id, key and
    start back from a column of such. Usual ids and starts fit one number, which a shuffle
    carries in a third of a struct's bytes."""
    odd = F.coalesce(~F.col("doc_id").between(0, 2 ** 39 - 1), F.lit(True)) | (
        F.col("key") != 0) | (F.col("start") >= 2 ** 24)
    if rows.agg(F.bool_or(odd)).first()[0]:
        return F.struct("doc_id", "key", "start"), F.col
    return (F.shiftleft("doc_id", 24).bitwiseOR(F.col("start").cast("long")),
            lambda name: F.struct(
                F.shiftright(name, 24).alias("doc_id"), F.lit(0).cast("long").alias("key"),
                F.col(name).bitwiseAND(2 ** 24 - 1).cast("int").alias("start")))


def repeated_windows(texts: DataFrame, window: int, anchor: int, bits: int,
                     shard_fragments: int) -> DataFrame:
    """(_known, _id, _key, _starts): for each text the (start, mask) of its fragments with
    windows that occur earlier."""
    rows = materialise(fragments(texts, window, anchor))
    own = ["anchor", "print"]
    at, told_from = places(rows)
    distinct = materialise(rows.groupBy(*own).agg(F.min(at).alias("first")))
    mixed = materialise(distinct.groupBy("anchor").count().filter(F.col("count") > 1))
    wanted = materialise(join_list(distinct, mixed, ["anchor"], "left_semi").select(
        *own, told_from("first").alias("first")))
    words = fragment_words(texts, wanted, window, anchor, bits)
    hot = key_list(mixed.filter(F.col("count") > shard_fragments), ["anchor"])
    if hot.rows.isEmpty():
        masks = shard_masks(wanted, words, window, shard_fragments)
    else:
        words = materialise(words)
        masks = shard_masks(join_list(wanted, hot, ["anchor"], "left_anti"),
                            join_list(words, hot, ["anchor"], "left_anti"),
                            window, shard_fragments)
        told = join_list(words, hot, ["anchor"], "left_semi").groupBy(*own).agg(
            F.max("text").alias("text"))
        masks = masks.unionByName(window_masks(
            join_list(wanted, hot, ["anchor"], "left_semi").join(told, own), window))
    masks = materialise(masks)
    # Of equal fragments all but the first have every window earlier.
    firsts = distinct.select(told_from("first").alias("at"))
    key, none = ["_known", "_id", "_key"], F.lit(0).cast("long")
    marks = (rows.select(*place(F.col("doc_id"), F.col("key")), "start",
                         F.expr("shiftleft(1L, n) - 1").alias("all"),
                         F.lit(None).cast("long").alias("mask"))
             .unionByName(firsts.select(*place(F.col("at.doc_id"), F.col("at.key")), "at.start",
                                        none.alias("all"), none.alias("mask")))
             .unionByName(masks.select(*key, "start", none.alias("all"), "mask"))
             .repartition(*key).groupBy(*key, "start")
             .agg(F.max("all").alias("all"), F.bit_or("mask").alias("mask"))
             .withColumn("mask", F.coalesce("mask", "all")).filter("mask != 0"))
    return marks.groupBy(*key).agg(F.collect_list(F.struct("start", "mask")).alias("_starts"))


# ------------------------------------------------------------------ removal --
def covered(n_words: int, starts: list[dict] | None, window: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    for s in starts or ():
        mask, at = s["mask"], s["start"]
        while mask:
            if mask & 1:
                edges[at] += 1
                edges[at + window] -= 1
            mask, at = mask >> 1, at + 1
    return np.cumsum(edges[:-1]) > 0


def runs(flags: np.ndarray) -> list[dict]:
    turns = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"start": int(a), "stop": int(b)} for a, b in turns.reshape(-1, 2)]


def ids_with_several_texts(docs: DataFrame) -> DataFrame:
    digest = F.xxhash64("text")
    return materialise(docs.groupBy("doc_id").agg(F.min(digest).alias("a"),
                                                  F.max(digest).alias("b"))
                       .filter("a != b").select(F.col("doc_id").isNotNull().alias("_known"),
                                                F.coalesce("doc_id", F.lit(0)).alias("_id")))


def told_apart(rows: DataFrame, several: DataFrame) -> DataFrame:
    """`rows` (doc_id, text and others) with a key, which is 0 but for an id that has several
    texts: there it is the text's hash."""
    if several.isEmpty():
        return rows.withColumn("key", F.lit(0).cast("long"))
    known = rows.withColumns({"_known": F.col("doc_id").isNotNull(),
                              "_id": F.coalesce("doc_id", F.lit(0))})
    joined = known.join(several.withColumn("_several", F.lit(True)), ["_known", "_id"], "left")
    return joined.select(*rows.columns, F.when(F.col("_several"), F.xxhash64("text"))
                         .otherwise(0).alias("key"))


def place(doc_id: Column, key: Column) -> list[Column]:
    return [doc_id.isNotNull().alias("_known"),
            F.coalesce(doc_id.cast("long"), F.lit(0)).alias("_id"), key.alias("_key")]


ADDED = "n_words long, n_removed long, spans array<struct<start:int,stop:int>>, _kept binary"


def dedup_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
                bits: int = bitfilter.BITS, shard_fragments: int = SHARD_FRAGMENTS) -> DataFrame:
    """`docs` with every word removed from `text` that lies in a window of `window` words
    which also starts earlier, in a smaller doc_id or earlier in the same text; and n_words,
    n_removed and the removed maximal `spans` (word numbers, stop excluded).

    Words are what ASCII white space divides; those kept are joined by one space. A null
    text stays null and has no words, an empty or blank one becomes empty. A null doc_id
    comes before all others. Rows of one doc_id and one text are one document, and have the
    same result; rows of one doc_id with different texts are documents of their own, in the
    order of their texts' hashes. Other columns pass through; ones named like an added
    column are replaced, and a column n_chars follows the new text."""
    if not anchor < window <= anchor + 62:
        raise ValueError("a window is longer than its anchor, by 62 words at most")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = ids_with_several_texts(texts)
    texts = told_apart(texts, several)
    found = repeated_windows(texts, window, anchor, bits, shard_fragments)
    # All of a row is one struct, so that no name of its columns meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = told_apart(rows, several).select("_row", *place(F.col("doc_id"), F.col("key"))).join(
        found, ["_known", "_id", "_key"], "left")
    taken = {f.split()[0] for f in ADDED.split(", ")} | {"_starts"}
    passed = [c for c in docs.columns if c.lower() not in taken]
    both = both.select(*[F.col(f"_row.`{c}`").alias(c) for c in passed], "_starts")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            nulls = batch.column(at).is_null().to_pylist()
            marks = batch.column(batch.schema.get_field_index("_starts")).to_pylist()
            n_words, n_removed, spans, kept = [], [], [], []
            for text, null, starts in zip(text_bytes(batch), nulls, marks):
                words = text.split()
                gone = covered(len(words), starts, window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                spans.append(runs(gone))
                kept.append(None if null else b" ".join(
                    [w for w, g in zip(words, gone.tolist()) if not g]))
            yield [n_words, n_removed, spans, kept]

    out = append_columns(both, ADDED, run, consumed=("text", "_starts"))
    out = out.withColumn("text", F.col("_kept").cast("string")).drop("_kept")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    names = [c for c in docs.columns if c.lower() not in taken]
    return out.select(*[f"`{c}`" for c in names], "n_words", "n_removed", "spans")
