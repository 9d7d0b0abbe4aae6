"""Language-model scores by online logistic context mixing.

A text is the sequence of its words (ASCII lower case, at ASCII white space) and an end.
Each word is a path of binary decisions: through a Huffman tree over the ``FREQUENT``
most frequent words, and where that says "another word", byte by byte through Huffman
trees that depend on the byte before, closed by a blank. So a word costs about as many
decisions as it has bits of information. Every decision is predicted in several contexts:

* in the tree of words: the node alone; with the text's script class (the last byte above
  ASCII in the ``REACH`` words before); with the word before;
* in the spelling: the byte before; the three bytes before; the word so far.

All but the first have hashed tables. The contexts' log-odds are mixed by weights that a
gate picks (depth in the tree, place in the word); the mix is corrected by gate and
rounded value; after each word, weights and corrections take a step along the gradient
of its code length. The sum of all decisions' logarithms is the score, a probability over
all sequences of words, and gives total bits per byte.

All statistics come from the training rows: word counts over the whole corpus, from
which the trees and the spelling's tables follow, and one more pass for the tables of
the words' contexts. Tables have a fixed size and are summed by chunks, in rounds.

Weights start anew every ``SEGMENT`` words; so a text's score does not depend on what it
is scored with, and a worker steps through thousands of segments at once. The frequent
words are sent to all tasks; the counts of the others, for the base score, come by a join.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import crc_remainder, give_back, materialise, text_bytes

FOLDS, HELD_OUT = 7, 2
FREQUENT = 2 ** 18      # words in the tree, whose counts every task gets
FLUSH = 300_000         # distinct words a task holds while counting
BLANK = 0x20
REACH = 16
WORD_BITS, SPELL_BITS = 20, 21
WORD_TABLES, SPELL_TABLES = 2, 3
TABLE_ROWS = 2_000_000  # counted words behind one task's tables
CHUNK = 2 ** 14         # slots that are summed together
SUMMED = 64             # tasks whose tables are summed in one group
TOKENS = 2 ** 18        # words handled at once
SPELLED = 20_000        # words spelled at once while counting
PRIOR = 0.4             # added to both counts of a context
SEGMENT = 256           # words that are mixed in one run
STEPPED = 2 ** 17       # words whose segments are stepped through together
GATES = 4               # of the tree, and of the spelling
TREE_START, SPELL_START = (0.25, 0.75, 0.05), (0.15, 0.45, 0.45)
RATE, FAST, STEP = 0.02, 0.1, 0.02      # FAST falls with the words seen
ROUNDS = 16             # rounded log-odds of the correction
LIMIT = 14.0
LONGEST = 64            # bytes of a word that "the word so far" tells apart
M1, M2, M3 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
WIDE = np.uint64(0x9E3779B97F4A7C15)


def spread(context: np.ndarray) -> np.ndarray:
    """A 64-bit context as a 32-bit hash."""
    x = (context + np.uint64(1)) * WIDE
    return ((x ^ (x >> np.uint64(29))) * WIDE >> np.uint64(32)).astype(np.uint32)


def hashed(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of (context, node), the context spread before."""
    x = node * M1
    x ^= context
    x *= M2
    x ^= x >> np.uint32(15)
    x *= M3
    return (x >> np.uint32(32 - bits)).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of each member of the ranges starts[i], ..., + sizes[i] - 1."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(ends[-1] if len(ends) else 0) + (starts - (ends - sizes))[owner]


# ------------------------------------------------------------------- trees --
class Paths(NamedTuple):
    """Of each symbol the path's length and where its nodes and bits are; each inner
    node's log-odds of a 1."""
    length: np.ndarray
    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    odds: np.ndarray


def huffman(weights: np.ndarray) -> Paths:
    """Inner nodes are numbered from the root, 0, on; equal weights merge in the order in
    which they come."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = np.zeros(max(1, 2 * n - 1), dtype=np.int64)
    side = np.zeros(max(1, 2 * n - 1), dtype=np.uint8)
    odds = np.zeros(max(1, n - 1), dtype=np.float32)
    for number in range(n, 2 * n - 1):
        wa, a = heapq.heappop(heap)
        wb, b = heapq.heappop(heap)
        parent[a] = parent[b] = number
        side[b] = 1
        odds[2 * n - 2 - number] = math.log(max(wb, 1e-9) / max(wa, 1e-9))
        heapq.heappush(heap, (wa + wb, number))
    root = 2 * n - 2
    depth = np.zeros(max(1, 2 * n - 1), dtype=np.int64)
    for number in range(root - 1, -1, -1):
        depth[number] = depth[parent[number]] + 1
    length = depth[:n].copy()
    start = np.cumsum(length) - length
    node = np.zeros(int(length.sum()), dtype=np.uint32)
    bit = np.zeros(len(node), dtype=np.uint8)
    at, put = np.arange(n), start + length - 1
    while len(at) and (going := at != root).any():
        at, put = at[going], put[going]
        node[put] = root - parent[at]
        bit[put] = side[at]
        at, put = parent[at], put - 1
    return Paths(length, start, node, bit, odds)


def byte_paths(pairs: np.ndarray) -> Paths:
    """A tree for each byte before, from the counts of (byte before, byte). One count in
    all is spread over every byte, so that each can be spelled."""
    overall = pairs.sum(0) + 1 / 256
    overall /= overall.sum()
    trees = [huffman(row + overall) for row in pairs]
    ends = np.cumsum([len(t.node) for t in trees])
    return Paths(np.concatenate([t.length for t in trees]),
                 np.concatenate([t.start + e - len(t.node) for t, e in zip(trees, ends)]),
                 np.concatenate([t.node for t in trees]), np.concatenate([t.bit for t in trees]),
                 np.zeros(1, dtype=np.float32))


# ------------------------------------------------------------------- words --
class Known(NamedTuple):
    """The frequent words: number 0 stands for all others."""
    joined: bytes
    logs: np.ndarray            # log10(count + 1)
    high: np.ndarray            # class that the word sets, or 0
    paths: Paths

    def numbers(self) -> dict[bytes, int]:
        names = self.joined.split(b"\n") if len(self.logs) > 1 else []
        return {w: i for i, w in enumerate(names, 1)}


def high_of(word: bytes) -> int:
    """The class a word sets: from its last byte above ASCII; 0 if it has none."""
    return 0 if word.isascii() else next(b for b in reversed(word) if b >= 128) & 63 | 64


def frequent_words(words: DataFrame, limit: int = FREQUENT) -> tuple[Known, int]:
    """Those with the least count such that at most `limit` words have it, and that count.
    Counts are looked through by eighths of a power of two."""
    level = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, 1
    for eighth, n in sorted(words.groupBy(level.alias("l")).count().collect(), reverse=True):
        if total + n > limit:
            least = math.ceil(2 ** ((eighth + 1) / 8) - 1e-9)
            break
        total += n
    common = words.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").toArrow()
    others = words.filter(F.col("n") < least).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names, n = common.column("word").to_pylist(), common.column("n").to_numpy()
    return Known(b"\n".join(names), np.log10(np.append(0, n) + 1.0),
                 np.array([0, *map(high_of, names)], dtype=np.uint8),
                 huffman(np.append(others + 1, n))), least


class Tokens(NamedTuple):
    """Words one behind the other."""
    number: np.ndarray          # 0: not a frequent word
    kind: np.ndarray            # hash of the class
    before: np.ndarray          # hash of the word before
    rare: list[bytes]           # the words numbered 0
    rare_at: np.ndarray
    cuts: np.ndarray            # of the texts
    sizes: np.ndarray           # bytes of the texts' words, each with its blank or end


def tokens_of(texts: list[bytes], numbers: dict[bytes, int], known: Known) -> Tokens:
    words: list[bytes] = []
    cuts = [0]
    sizes = []
    for text in texts:
        own = text.lower().split()
        sizes.append(sum(map(len, own)) + len(own) + 1)
        words += own
        words.append(b"")
        cuts.append(len(words))
    number = np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words))
    rare_at = np.flatnonzero(number == 0)
    rare = [words[i] for i in rare_at.tolist()]
    cuts = np.array(cuts)
    first = np.repeat(cuts[:-1], np.diff(cuts))
    here = np.arange(len(words))
    high = known.high[number]
    high[rare_at] = [high_of(w) for w in rare]
    last = np.maximum.accumulate(np.where(high > 0, here, -1))
    last = np.concatenate([[-1], last[:-1]])
    kind = np.where((last >= first) & (here - last <= REACH), high[last], 0)
    value = number.astype(np.uint64)
    value[rare_at] = [zlib.crc32(w) | 1 << 32 for w in rare]
    before = np.where(here > first, np.concatenate([value[:1], value[:-1]]), np.uint64(1 << 40))
    return Tokens(number, spread(kind.astype(np.uint64)), spread(before ^ np.uint64(1 << 41)), rare,
                  rare_at, cuts, np.array(sizes, dtype=np.int64))


class Steps(NamedTuple):
    """Decisions of words, one behind the other."""
    owner: np.ndarray           # the word
    of: np.ndarray              # what the contexts belong to: a word, or one of its bytes
    node: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    contexts: list[np.ndarray]
    bits: int

    def slot(self, k: int) -> np.ndarray:
        return hashed(self.contexts[k][self.of], self.node, self.bits)


def word_steps(number, kind, before, paths: Paths) -> Steps:
    """Gates go by the depth in the tree."""
    size, start = paths.length[number], paths.start[number]
    owner, at = ranges(start, size)
    gate = np.minimum(at - start[owner] >> 2, GATES - 1).astype(np.int8)
    return Steps(owner, owner, paths.node[at], paths.bit[at], gate, [kind, before], WORD_BITS)


PLACES = np.arange(1, LONGEST + 1, dtype=np.uint64) * WIDE | np.uint64(1)


def spelled(words: list[bytes], paths: Paths) -> Steps:
    """Gates go by the place in the word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 1
    symbol = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    owner, at = ranges(np.zeros(len(words), dtype=np.int64), sizes)
    one, two, three = (np.where(at >= k, np.roll(symbol, k), BLANK).astype(np.uint64)
                       for k in (1, 2, 3))
    term = (symbol.astype(np.uint64) + np.uint64(1)) * PLACES[np.minimum(at, LONGEST - 1)]
    term = (term ^ (term >> np.uint64(29))) * WIDE
    total = np.cumsum(term) - term
    prefix = total - total[begin][owner] if len(words) else total
    path = one.astype(np.int64) * 256 + symbol
    of, where = ranges(paths.start[path], paths.length[path])
    contexts = (one, one | two << np.uint64(8) | three << np.uint64(16) | np.uint64(1 << 40),
                prefix ^ np.uint64(1 << 50))
    return Steps(owner[of], of, paths.node[where], paths.bit[where],
                 np.minimum(at, GATES - 1).astype(np.int8)[of],
                 [spread(c + (one << np.uint64(52))) for c in contexts], SPELL_BITS)


# ------------------------------------------------------------------ tables --
def word_counts(train: DataFrame) -> DataFrame:
    """(word, n): how often the training rows have each word; the end is the empty one."""
    def run(batches):
        def rows(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()),
                                               pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])
        held = Counter()
        for batch in batches:
            for text in text_bytes(batch):
                held.update(text.lower().split())
                held[b""] += 1
                if len(held) > FLUSH:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)
        del held
        give_back()

    return (train.select("text").mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def byte_pairs(counts: DataFrame) -> np.ndarray:
    """How often each byte follows each, in words with their blanks."""
    def run(batches):
        total = np.zeros(65536)
        for batch in batches:
            words = batch.column(0).to_pylist()
            sizes = np.array([len(w) + 1 for w in words])
            symbol = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
            before = np.roll(symbol, 1)
            before[np.cumsum(sizes) - sizes] = BLANK
            total += np.bincount(before * 256 + symbol, np.repeat(
                np.asarray(batch.column(1), dtype=np.float64), sizes), 65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))],
                                         ["pair", "n"])

    pairs = np.zeros(65536)
    for pair, n in counts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(
            F.sum("n")).collect():
        pairs[pair] = n
    return pairs.reshape(256, 256)


PARTS = "part long, task long, data binary"


def parts_of(tables: np.ndarray):
    """A task's tables [table, slot, bit] in chunks, those that hold anything."""
    task = TaskContext.get().partitionId()
    flat = tables.reshape(-1, CHUNK * 2)
    for part in np.flatnonzero(flat.any(1)).tolist():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([task], pa.int64()),
             pa.array([flat[part].astype(np.float32).tobytes()], pa.binary())],
            ["part", "task", "data"])


def log_odds(parts: DataFrame, tasks: int, tables: int, bits: int) -> np.ndarray:
    """[table, slot] log-odds of a 1, from the sums of all tasks' parts; 0 where nothing
    was seen."""
    def summed(pdf):
        return sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["data"])

    def some(pdf):
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["group"].iloc[0]],
                             "data": [summed(pdf).astype(np.float32).tobytes()]})

    def total(pdf):
        zeros, ones = summed(pdf).reshape(CHUNK, 2).T
        value = np.log((ones + PRIOR) / (zeros + PRIOR)).astype(np.float16)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "data": [value.tobytes()]})

    while tasks > SUMMED:
        parts = parts.withColumn("group", F.floor(F.col("task") / SUMMED)).groupBy(
            "part", "group").applyInPandas(some, PARTS)
        tasks = -(-tasks // SUMMED)
    out = np.zeros(tables << bits, dtype=np.float16)
    for part, data in materialise(parts.groupBy("part").applyInPandas(
            total, "part long, data binary")).toLocalIterator():
        out[part * CHUNK:(part + 1) * CHUNK] = np.frombuffer(data, np.float16)
    return out.reshape(tables, 1 << bits)


def spelling_odds(counts: DataFrame, rows: int, paths: Paths) -> np.ndarray:
    """The spelling's tables from the counted words."""
    sent = counts.sparkSession.sparkContext.broadcast(paths)
    tasks = max(1, -(-rows // TABLE_ROWS))

    def run(batches):
        tables = np.zeros((SPELL_TABLES, 2 << SPELL_BITS))
        for batch in batches:
            words, n = batch.column(0).to_pylist(), np.asarray(batch.column(1), dtype=np.float64)
            for at in range(0, len(words), SPELLED):
                found = spelled(words[at:at + SPELLED], sent.value)
                times = n[at:at + SPELLED][found.owner]
                for k, table in enumerate(tables):
                    np.add.at(table, found.slot(k) * 2 + found.bit, times)
        yield from parts_of(tables)
        del tables
        give_back()

    out = log_odds(counts.repartition(tasks).mapInArrow(run, PARTS), tasks, SPELL_TABLES,
                   SPELL_BITS)
    sent.destroy()
    return out


def count_into(table: np.ndarray, number: np.ndarray, context: np.ndarray, paths: Paths) -> None:
    """Add the words' decisions to a table; equal words in equal contexts are added together."""
    pairs, times = np.unique(number << 32 | context, return_counts=True)
    number = pairs >> 32
    owner, at = ranges(paths.start[number], paths.length[number])
    slot = hashed((pairs & 0xFFFFFFFF).astype(np.uint32)[owner], paths.node[at], WORD_BITS)
    slot *= 2
    slot += paths.bit[at]
    np.add.at(table, slot, times.astype(np.float32)[owner])


def context_odds(train: DataFrame, known: Known) -> np.ndarray:
    """The words' tables, from a pass over the training texts."""
    sent = train.sparkSession.sparkContext.broadcast(known)
    ready: list = []

    def run(batches):
        if not ready:
            ready.extend([sent.value, sent.value.numbers()])
        known, numbers = ready
        tables = np.zeros((WORD_TABLES, 2 << WORD_BITS))
        fresh, held = np.zeros(tables.shape, dtype=np.float32), 0   # exact up to 2 ** 24
        for batch in batches:
            for _, texts in chunks(text_bytes(batch)):
                t = tokens_of(texts, numbers, known)
                for at in range(0, len(t.number), TOKENS):
                    own = slice(at, at + TOKENS)
                    for table, context in zip(fresh, (t.kind[own], t.before[own])):
                        count_into(table, t.number[own], context, known.paths)
                    held += TOKENS
                    if held > 2 ** 23:
                        tables += fresh
                        fresh[:], held = 0, 0
        tables += fresh
        yield from parts_of(tables)
        del tables, fresh
        give_back()

    source = train.select("text")
    out = log_odds(source.mapInArrow(run, PARTS), source.rdd.getNumPartitions(), WORD_TABLES,
                   WORD_BITS)
    sent.destroy()
    return out


def chunks(texts: list[bytes]):
    """(first, texts): runs of texts of about ``TOKENS`` words."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= 6 * TOKENS or i + 1 == len(texts):
            yield at, texts[at:i + 1]
            at, size = i + 1, 0


# ------------------------------------------------------------------ mixing --
class Model(NamedTuple):
    known: Known
    spelling: Paths
    word_odds: np.ndarray
    spelling_odds: np.ndarray

    def unpacked(self) -> Model:
        return self._replace(word_odds=self.word_odds.astype(np.float32),
                             spelling_odds=self.spelling_odds.astype(np.float32))


def mixed(odds: list[np.ndarray], bit: np.ndarray, cells: np.ndarray, bounds: np.ndarray,
          start: tuple, n: int) -> np.ndarray:
    """The cost, a natural logarithm, of all decisions of each of n lanes. Those between
    bounds[k] and bounds[k + 1] are mixed together with what was learnt before. `cells`
    are lane * GATES + gate."""
    sign = bit.astype(np.float32) * 2 - 1
    weights = [np.full(n * GATES, x, dtype=np.float32) for x in start]
    shift = np.zeros(n * GATES * ROUNDS, dtype=np.float32)
    cost = np.empty(len(bit), dtype=np.float32)
    for turn, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if a == b:
            continue
        rate = RATE + FAST / (1 + turn / 4)
        g, s = cells[a:b], sign[a:b]
        o = [x[a:b] for x in odds]
        mix = o[0] * weights[0][g]
        mix += o[1] * weights[1][g]
        mix += o[2] * weights[2][g]
        wrong = mix + np.float32(ROUNDS / 2)
        np.maximum(wrong, 0, out=wrong)
        np.minimum(wrong, ROUNDS - 1, out=wrong)
        spot = g * ROUNDS
        spot += wrong.astype(np.int64)
        mix += shift[spot]
        mix *= s
        np.maximum(mix, -LIMIT, out=mix)
        np.minimum(mix, LIMIT, out=mix)
        np.negative(mix, out=mix)
        np.exp(mix, out=wrong)
        odd = cost[a:b]
        np.add(wrong, 1, out=odd)
        wrong /= odd
        wrong *= s
        for weight, x in zip(weights, o):
            weight += (rate * np.bincount(g, wrong * x, n * GATES)).astype(np.float32)
        np.add.at(shift, spot, STEP * wrong)
    np.log(cost, out=cost)
    return np.bincount(cells, cost, n * GATES).astype(np.float64).reshape(n, GATES).sum(1)


def mixed_logs(t: Tokens, start: np.ndarray, stop: np.ndarray, model: Model) -> np.ndarray:
    """The natural log-probability of each segment of tokens start[i]:stop[i]. All
    segments take a word at a time, side by side: the decisions of their k-th words are
    one slice of the arrays. Tree and spelling have gates of their own and so are mixed
    apart."""
    n = len(start)
    order = np.argsort(start - stop, kind="stable")
    first, size = start[order], (stop - start)[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    token = np.concatenate([first[:a] + k for k, a in enumerate(live.tolist())])
    lane = np.concatenate([np.arange(a) for a in live.tolist()])
    turns = np.concatenate([[0], np.cumsum(live)])
    number = t.number[token]

    words = word_steps(number, t.kind[token], t.before[token], model.known.paths)
    ends = np.concatenate([[0], np.cumsum(model.known.paths.length[number])])
    odds = [model.known.paths.odds[words.node],
            *[x[words.slot(k)] for k, x in enumerate(model.word_odds)]]
    bit, cells = words.bit, lane[words.owner] * GATES + words.gate
    del words
    cost = mixed(odds, bit, cells, ends[turns], TREE_START, n)
    del odds, bit, cells

    rare = np.flatnonzero(number == 0)
    if len(rare):
        text = [t.rare[i] for i in np.searchsorted(t.rare_at, token[rare]).tolist()]
        letters = spelled(text, model.spelling)
        ends = np.searchsorted(letters.owner, np.arange(len(rare) + 1))
        odds = [x[letters.slot(k)] for k, x in enumerate(model.spelling_odds)]
        bit, cells = letters.bit, lane[rare][letters.owner] * GATES + letters.gate
        del letters
        cost += mixed(odds, bit, cells, ends[np.searchsorted(rare, turns)], SPELL_START, n)
    out = np.empty(n)
    out[order] = -cost
    return out


def text_logs(t: Tokens, model: Model) -> np.ndarray:
    """The natural log-probability of each text."""
    size = np.diff(t.cuts)
    pieces = -(-size // SEGMENT)
    owner, number = ranges(np.zeros(len(size), dtype=np.int64), pieces)
    start = t.cuts[:-1][owner] + number * SEGMENT
    stop = np.minimum(start + SEGMENT, t.cuts[1:][owner])
    # Segments of about one length go together, so that few lanes end before the others.
    order = np.argsort(start - stop, kind="stable")
    group = np.cumsum((stop - start)[order]) // STEPPED
    logs = np.empty(len(start))
    for own in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        logs[own] = mixed_logs(t, start[own], stop[own], model)
    return np.bincount(owner, logs, len(size))


# ----------------------------------------------------------------- scoring --
SCORED = ("_row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, "
          "known long, logs double, model double, rare array<binary>")


def fit(train: DataFrame) -> tuple[Model, DataFrame, int, int, int]:
    """The model; the counted words, the least count of a frequent one, and the numbers of
    training words and of different ones."""
    words = materialise(word_counts(train))
    distinct, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    known, least = frequent_words(words)
    rare = words.filter(F.col("n") < least)
    spelling = byte_paths(byte_pairs(rare))
    model = Model(known, spelling, context_odds(train, known),
                  spelling_odds(rare, distinct - len(known.logs) + 1, spelling))
    return model, words, least, int(total), int(distinct)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) and
    bits_per_byte (of the words, each with its blank) of every row of `docs`.

    Trained on the rows whose crc32(doc_id as text) mod 7 is not 2 (rows without doc_id
    train). A null or blank text is the end alone. Equal rows each give a row; without any
    training row all counts are 0 and the contexts know nothing. `base_score` is the
    add-one unigram score over the training words."""
    held = crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    model, words, least, total, distinct = fit(docs.filter(~held))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ready: list = []

    def run(batches):
        if not ready:
            ready.extend([sent.value.unpacked(), sent.value.known.numbers()])
        model, numbers = ready
        for batch in batches:
            for at, texts in chunks(text_bytes(batch)):
                t = tokens_of(texts, numbers, model.known)
                size = np.diff(t.cuts)
                owner = np.repeat(np.arange(len(size)), size)
                rare_cuts = np.searchsorted(t.rare_at, t.cuts)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(at, len(texts)) for i in range(3)],
                     pa.array(size), pa.array(t.sizes),
                     pa.array(size - np.diff(rare_cuts)),
                     pa.array(np.bincount(owner, model.known.logs[t.number], len(size))),
                     pa.array(text_logs(t, model)),
                     pa.ListArray.from_arrays(pa.array(rare_cuts.astype(np.int32)),
                                              pa.array(t.rare, pa.binary()))],
                    [f.split()[0] for f in SCORED.split(", ")])
                del t, owner
                give_back()

    scored = materialise(docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", held.alias("held_out"), "text")
        .mapInArrow(run, SCORED))
    sent.destroy()
    rare = scored.select("_row", F.explode("rare").alias("word"))
    met = (rare.join(words.filter(F.col("n") < least), "word").groupBy("_row")
           .agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs")))
    base = (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
            - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1)))
    return scored.drop("rare").join(met, "_row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("model") / math.log(10)).alias("score"),
        (-F.col("model") / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"))
