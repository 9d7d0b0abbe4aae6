"""Toxicity from the nearest labelled examples.

Examples and the rows that calibrate the votes are bounded samples of the labelled rows
outside the held-out fold, taken by hashes of the id: a quarter of either label is set
apart for calibration (at most ``CALIBRATION`` rows of each), and of the rest
``EXAMPLES`` of each label are the examples. Every term of the examples is in the
vectors; its weight is the inverse document frequency over all documents times how well
it tells the examples' labels apart (chi-square), which is never zero. Each document finds
its nearest examples by the exact cosine: products over the terms that many examples hold
are made for all examples at once; for the other terms, blocks of examples keep the
largest weight of each, which bounds what they can add, and where few examples are left
that can reach the k-th best cosine, only these are scored. Votes weighted by distance
are set against the labels' true shares and calibrated by a logistic curve fitted on the
calibration rows, which are weighted to the same shares.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import (append_columns, crc_remainder, give_back, materialise,
                                text_bytes)
from duebook.llm.words import Texts, slices

FOLDS = 5               # held out: crc32 of the id's text divisible by this
EXAMPLES = 2048         # of each label
CALIBRATION = 4096      # of each label
APART = 4               # one labelled row of so many is for calibration,
FEWEST = 8              # of labels that have so many rows
FREQUENT = 0.1          # share of examples from which a term's weights are kept dense
NEAREST = 15
BLOCK = 32              # examples of a block
SPARSE = 8              # terms in more than a block of so many have dense maxima
BEGINNINGS = (4, 5)     # bytes of longer words that are terms too
TERMS = 2 ** 15         # terms hashed together
BATCH = 256             # documents that are scored together,
TOGETHER = 2 ** 17      # fewer if they have more terms
SOFT = 0.05             # added to distances, so that equal texts have finite weight

#: Words are runs of ASCII letters (A-Z lower-cased) and of all bytes above ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
             for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Words, and the beginnings of longer ones, which stand for a stem's forms."""
    words = text.translate(FOLD).split()
    return words + [w[:n] for n in BEGINNINGS for w in words if len(w) > n]


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


@dataclass(frozen=True)
class Sparse:
    """Rows of weights: row i has `weight[at[i]:at[i + 1]]` for the terms `term[...]`."""
    at: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    width: int

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        row, term = np.nonzero(dense)
        at = np.searchsorted(row, np.arange(len(dense) + 1))
        return cls(at, term, dense[row, term], dense.shape[1])

    def take(self, rows: np.ndarray) -> Sparse:
        n = self.at[rows + 1] - self.at[rows]
        at = np.concatenate([[0], np.cumsum(n)])
        pick = np.repeat(self.at[rows] - at[:-1], n) + np.arange(at[-1])
        return Sparse(at, self.term[pick], self.weight[pick], self.width)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(self.at))


class Vectors:
    """TF-IDF vectors of unit length over fixed terms. Of many texts at once, each spelling
    is looked up once: whole words by two hashes, beginnings by their bytes."""

    def __init__(self, terms: list[bytes], weights: np.ndarray):
        self.weights = weights
        hashes, second, short = [], [], {length: [] for length in BEGINNINGS}
        for at in range(0, max(1, len(terms)), TERMS):
            own = Texts([b" ".join(terms[at:at + TERMS])], FOLD)
            number, _, again = own.distinct()
            hashes.append(own.hashes)
            second.append(again[number])
            for length in BEGINNINGS:
                some = np.flatnonzero(own.stops - own.starts == length)
                short[length].append((own.beginnings(some, length), at + some))
        hashes, second = np.concatenate(hashes), np.concatenate(second)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.second = hashes[self.order], second[self.order]
        same = np.flatnonzero(np.diff(self.hashes, prepend=self.hashes[:1] + np.uint64(1)))
        self.most = int(np.diff(same, append=len(self.hashes)).max(initial=0))
        self.short = {}
        for length, parts in short.items():
            value, some = (np.concatenate(x) for x in zip(*parts))
            by = np.argsort(value)
            self.short[length] = value[by], some[by]

    def known(self, words: Texts, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The terms of each spelling (`first`: a word that has it), -1 for none."""
        found = np.full((len(first), 1 + len(BEGINNINGS)), -1)
        if not len(self.order):
            return found
        hashes = words.hashes[first]
        place = np.searchsorted(self.hashes, hashes)
        for k in range(self.most):
            at = np.minimum(place + k, len(self.order) - 1)
            hit = (self.hashes[at] == hashes) & (self.second[at] == second)
            found[hit, 0] = self.order[at[hit]]
        size = (words.stops - words.starts)[first]
        for column, (length, (values, terms)) in enumerate(self.short.items(), 1):
            longer = np.flatnonzero(size > length)
            if len(terms):
                value = words.beginnings(first[longer], length)
                at = np.minimum(np.searchsorted(values, value), len(terms) - 1)
                found[longer, column] = np.where(values[at] == value, terms[at], -1)
        return found

    def occurrences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, how often) of the terms in each text, in this order."""
        words = Texts(texts, FOLD)
        number, first, second = words.distinct()
        terms = self.known(words, first, second)[number]
        width = max(1, len(self.weights))
        both, n = np.unique((words.owners()[:, None] * width + terms)[terms >= 0],
                            return_counts=True)
        return both // width, both % width, n

    def rows(self, texts: list[bytes]) -> Sparse:
        row, term, n = self.occurrences(texts)
        value = (1.0 + np.log(n)) * self.weights[term]
        length = np.sqrt(np.bincount(row, value * value, len(texts)))
        return Sparse(np.searchsorted(row, np.arange(len(texts) + 1)), term,
                      value / length[row], len(self.weights))


class Found(NamedTuple):
    """Of each document, nearest first: cosines (-1 where there are fewer) and examples."""
    cosine: np.ndarray
    example: np.ndarray


class BlockMaxIndex:
    """Examples by term: dense for frequent terms, inverted lists for the others, whose
    largest weight in each block of examples is kept."""

    def __init__(self, weights: np.ndarray | Sparse):
        """`weights`: unit rows. They are put into blocks with their likes: by their
        heaviest term and its weight."""
        rows = Sparse.of(weights) if isinstance(weights, np.ndarray) else weights
        self.n = len(rows.at) - 1
        heaviest, top = np.full(self.n, -1), np.zeros(self.n)
        by, row = np.lexsort((-rows.term, rows.weight)), rows.row_of()
        heaviest[row[by]], top[row[by]] = rows.term[by], rows.weight[by]
        del by
        self.order = np.lexsort((-top, heaviest))
        rows = rows.take(self.order)
        row = rows.row_of()
        held = np.bincount(rows.term, minlength=rows.width)
        frequent = held >= max(2, FREQUENT * self.n)
        self.column = np.where(frequent, np.cumsum(frequent) - 1, -1)
        often = frequent[rows.term]
        self.dense = np.zeros((int(frequent.sum()), self.n))
        self.dense[self.column[rows.term[often]], row[often]] = rows.weight[often]
        row, term, weight = row[~often], rows.term[~often], rows.weight[~often]
        width = rows.width
        del rows, often
        self.rare = Sparse(np.searchsorted(row, np.arange(self.n + 1)), term, weight, width)
        self.asked = np.zeros(width)
        by = np.argsort(term, kind="stable")
        row, term, weight = row[by], term[by], weight[by]
        del by
        terms = np.arange(width + 1)
        self.lists = Sparse(np.searchsorted(term, terms), row, weight, self.n)
        # Of each term only the blocks that hold it: at most as many as examples do.
        block = row // BLOCK
        new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
        self.blocks = -(-self.n // BLOCK)
        term, block = term[new], block[new]
        weight = np.maximum.reduceat(weight, new) if len(new) else weight
        held = np.bincount(term, minlength=width)
        many = held * SPARSE > self.blocks
        self.wide = np.where(many, np.cumsum(many) - 1, -1)
        often = many[term]
        self.wide_maxima = np.zeros((int(many.sum()), self.blocks), dtype=np.float32)
        self.wide_maxima[self.wide[term[often]], block[often]] = np.nextafter(
            weight[often].astype(np.float32), np.float32(2))
        term, block, weight = term[~often], block[~often], weight[~often]
        self.maxima = Sparse(np.searchsorted(term, terms), block, weight, self.blocks)

    def nearest(self, rows: np.ndarray | Sparse, k: int = NEAREST) -> Found:
        """Exact, ties to the first example; cosines are rounded to 12 places, so that
        equal ones are equal however the sums were made."""
        rows = Sparse.of(rows) if isinstance(rows, np.ndarray) else rows
        n, width = len(rows.at) - 1, min(k, self.n)
        best = np.full((n, width), -1.0)
        who = np.full((n, width), self.n, dtype=np.int64)
        a = 0 if self.n else n
        while a < n:
            to = max(a + 1, min(a + BATCH, n, int(
                np.searchsorted(rows.at, rows.at[a] + TOGETHER, side="right")) - 1))
            part = rows.take(np.arange(a, to))
            column, row = self.column[part.term], part.row_of()
            known = column >= 0
            own = np.zeros((len(part.at) - 1, len(self.dense)))
            own[row[known], column[known]] = part.weight[known]
            sums = own @ self.dense
            rest = Sparse(np.searchsorted(row[~known], np.arange(to - a + 1)),
                          part.term[~known], part.weight[~known], part.width)
            for i, (cosine, more) in enumerate(zip(sums, self.most(rest))):
                mine = slice(rest.at[i], rest.at[i + 1])
                self.add(cosine, more, rest.term[mine], rest.weight[mine], width)
                cosine = np.round(cosine, 12)
                least = np.partition(cosine, self.n - width)[self.n - width]
                some = np.flatnonzero(cosine >= max(least, 1e-12))
                some = some[np.lexsort((self.order[some], -cosine[some]))[:width]]
                best[a + i, :len(some)], who[a + i, :len(some)] = cosine[some], self.order[some]
            a = to
        return Found(best, who)

    def most(self, rows: Sparse) -> np.ndarray:
        """For each row what its terms (none frequent) can add in each block, at most."""
        row, column = rows.row_of(), self.wide[rows.term]
        narrow = column < 0
        blocks = self.maxima.take(rows.term[narrow])
        times = np.diff(blocks.at)
        more = np.bincount(np.repeat(row[narrow], times) * self.blocks + blocks.term,
                           blocks.weight * np.repeat(rows.weight[narrow], times),
                           (len(rows.at) - 1) * self.blocks).reshape(-1, self.blocks)
        row, column, weight = row[~narrow], column[~narrow], rows.weight[~narrow]
        weight = weight.astype(np.float32)
        at = np.searchsorted(row, np.arange(len(more) + 1))
        for i, (a, b) in enumerate(zip(at, at[1:])):
            if b > a:
                more[i] += weight[a:b] @ self.wide_maxima.take(column[a:b], axis=0)
        return more * 1.0001 + 1e-6

    def add(self, cosine: np.ndarray, more: np.ndarray, term: np.ndarray, weight: np.ndarray,
            width: int) -> None:
        """Add the products over the terms that are not frequent, where they can matter;
        examples that cannot be among the nearest are set to -1."""
        if not len(term):
            return
        least = np.partition(cosine, self.n - width)[self.n - width]
        able = cosine + np.repeat(more, BLOCK)[:self.n] >= least
        few = np.flatnonzero(able)
        if (self.rare.at[few + 1] - self.rare.at[few]).sum() < (
                self.lists.at[term + 1] - self.lists.at[term]).sum():
            rows = self.rare.take(few)
            self.asked[term] = weight
            cosine[few] += np.bincount(rows.row_of(), rows.weight * self.asked[rows.term], len(few))
            self.asked[term] = 0.0
        else:
            lists = self.lists.take(term)
            cosine += np.bincount(lists.term, lists.weight * np.repeat(weight, np.diff(lists.at)),
                                  self.n)
        cosine[~able] = -1.0


def votes(found: Found, toxic: np.ndarray, share: float) -> np.ndarray:
    """The weighted share of toxic neighbours, weights falling with the distance and set
    against the labels' shares (`share` is toxic among all labels); NaN without any."""
    known = found.cosine > 0
    weight = np.where(known, 1.0 / (1.0 - np.minimum(found.cosine, 1.0) + SOFT), 0.0)
    label = np.append(toxic, 0)[np.minimum(found.example, len(toxic))]
    half = toxic.mean() if len(toxic) else 0.5
    for_, against = ((weight * (label == v)).sum(1) * (p / max(q, 1e-9)) for v, p, q in (
        (1, share, half), (0, 1 - share, 1 - half)))
    total = for_ + against
    return np.divide(for_, total, out=np.full(len(total), np.nan), where=total > 0)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None
             ) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge towards the identity; a
    step is halved until the loss falls."""
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.array([1.0, 0.01])
    now = np.array([1.0, 0.0])

    def loss(at):
        z = at[0] * x + at[1]
        return ((weight * (np.logaddexp(0, z) - y * z)).sum()
                + (ridge * (at - [1.0, 0.0]) ** 2).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(now[0] * x + now[1], -30, 30)))
        w, r = weight * p * (1 - p), weight * (p - y)
        g = np.array([(r * x).sum(), r.sum()]) + ridge * (now - [1.0, 0.0])
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]])
        step, before = np.linalg.solve(h + np.diag(ridge), g), loss(now)
        while np.abs(step).max() > 1e-9 and not loss(now - step) < before:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        now = now - step
    return float(now[0]), float(now[1])


class Model(NamedTuple):
    terms: list[bytes]
    by_term: np.ndarray         # weights
    weights: Sparse             # of the examples
    toxic: np.ndarray
    ids: np.ndarray
    share: float                # of toxic among the labels
    empty: float                # the score without any neighbour
    slope: float
    intercept: float


def sampled(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, toxic, part) of the sampled labelled rows, part 0 being examples and part
    1 for calibration; and (doc_id, toxic) of all that may be learnt from. A doc_id
    labelled more than once counts once, as toxic if any row says so."""
    learn = materialise(
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .filter(crc_remainder(F.col("doc_id"), FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    many = {r["toxic"]: r["count"] >= FEWEST for r in learn.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(APART)) == 0
    parts = []
    for label in (1, 0):
        rows = learn.filter(F.col("toxic") == label)
        for part, most, own in ((0, EXAMPLES, ~apart), (1, CALIBRATION, apart)):
            own = own if many.get(label) else F.lit(part == 0)
            parts.append(rows.filter(own).orderBy(*order).limit(most)
                         .withColumn("part", F.lit(part)))
    return materialise(parts[0].union(parts[1]).union(parts[2]).union(parts[3])), learn


def weighed_terms(examples: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """All terms of the examples, and how well the presence of each tells the labels
    apart: (chi-square + 1) a row, 1 being what chance gives."""
    def run(batches):
        held = [Counter(), Counter()]
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), text_bytes(batch)):
                held[label].update(set(terms_of(text)))
        for label, counts in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array([label] * len(counts), pa.int32()),
                 pa.array(list(counts.values()), pa.int64())], ["term", "toxic", "n"])
        del held, counts
        give_back()

    n1, n0 = (float(n or 0) for n in examples.agg(
        F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n1 or not n0:
        return [], np.zeros(0)
    a, b = (F.sum(F.when(F.col("toxic") == v, F.col("n")).otherwise(0)).cast("double")
            for v in (1, 0))
    found = (examples.select("text", "toxic").mapInArrow(run, "term binary, toxic int, n long")
             .groupBy("term").agg(a.alias("a"), b.alias("b")).toArrow().sort_by("term"))
    a, b = found["a"].to_numpy(), found["b"].to_numpy()
    n, held = n1 + n0, a + b
    chi = np.divide((a * (n0 - b) - b * (n1 - a)) ** 2 * n, held * (n - held) * n1 * n0,
                    out=np.zeros(len(a)), where=held < n)
    return found["term"].to_pylist(), (chi + 1) / n


def inverse_frequencies(docs: DataFrame, terms: list[bytes]) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the term)) + 1 over all of `docs`."""
    def run(batches):
        vectors, n, held = Vectors(terms, np.ones(len(terms))), 0, np.zeros(len(terms), np.int64)
        for _, texts in slices(batches):
            n += len(texts)
            held += np.bincount(vectors.occurrences(texts)[1], minlength=len(terms))
        del vectors
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(terms))),
                                          pa.array(np.append(n, held))], ["term", "n"])

    counted = (docs.select("text").mapInArrow(run, "term long, n long")
               .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    n = np.zeros(len(terms) + 1)
    n[counted["term"].to_numpy() + 1] = counted["n"].to_numpy()
    return np.log((1 + n[0]) / (1 + n[1:])) + 1


def vectors_of(examples: DataFrame, terms: list[bytes], by_term: np.ndarray) -> pa.Table:
    """doc_id, toxic and the vector (terms and weights as bytes) of each example, by id."""
    def run(batches):
        vectors = Vectors(terms, by_term)
        for batch in batches:
            own = vectors.rows(text_bytes(batch))
            cuts = list(zip(own.at, own.at[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([own.term[a:b].astype(np.int64).tobytes() for a, b in cuts], pa.binary()),
                 pa.array([own.weight[a:b].tobytes() for a, b in cuts], pa.binary())],
                ["doc_id", "toxic", "term", "weight"])
        del vectors
        give_back()

    return (examples.select("doc_id", "toxic", "text")
            .mapInArrow(run, "doc_id long, toxic int, term binary, weight binary")
            .toArrow().sort_by("doc_id"))


def calibration_votes(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The votes on each calibration row, and the labels."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        vectors, index = Vectors(model.terms, model.by_term), BlockMaxIndex(model.weights)
        give_back()         # what building took
        for rows, texts in slices(batches):
            raw = votes(index.nearest(vectors.rows(texts)), model.toxic, model.share)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(raw)],
                                             ["doc_id", "toxic", "raw"])
        del vectors, index
        give_back()

    found = (rows.select("doc_id", "toxic", "text")
             .mapInArrow(run, "doc_id long, toxic int, raw double").toArrow().sort_by("doc_id"))
    sent.unpersist()
    return found["raw"].to_numpy(), found["toxic"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows outside the held-out fold. Without labels of both
    kinds every score is the share of toxic labels, a half if there are none. Of rows
    with one doc_id the least text is taken."""
    chosen, learn = sampled(labels)
    n, share = learn.agg(F.count("*"), F.avg("toxic")).first()
    share = 0.5 if not n else (share * n + 0.5) / (n + 1)
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                         .groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")))
    terms, by_term = weighed_terms(sample.filter("part = 0"))
    by_term = by_term * inverse_frequencies(docs, terms)
    rows = vectors_of(sample.filter("part = 0"), terms, by_term)
    part = [np.frombuffer(x, own) for name, own in (("term", np.int64), ("weight", float))
            for x in [b"".join(rows[name].to_pylist())]]
    lengths = [len(x) // 8 for x in rows["term"].to_pylist()]
    vectors = Sparse(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]),
                     part[0].astype(np.int32), part[1], len(terms))
    example = np.flatnonzero(lengths)
    model = Model(terms, by_term, vectors.take(example), rows["toxic"].to_numpy()[example],
                  rows["doc_id"].to_numpy()[example], share, share, 1.0, 0.0)
    del rows, part, vectors
    raw, truth = calibration_votes(sample.filter("part = 1"), model)
    if not 0 < truth.sum() < len(truth):
        return model
    weight = np.where(truth == 1, share / truth.mean(), (1 - share) / (1 - truth.mean()))
    none = np.isnan(raw)
    empty = ((weight * truth)[none].sum() + share) / (weight[none].sum() + 1)
    slope, intercept = logistic(logit(raw[~none]), truth[~none], weight[~none])
    return model._replace(empty=float(empty), slope=slope, intercept=intercept)


ADDED = ("held_out boolean, score double, predicted int, "
         "evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with held_out, score (the calibrated chance of label 1), predicted (score of
    at least a half) and evidence: the three nearest examples. Scores depend on the text
    alone. Null, empty and other texts without any of the terms have no neighbours and get
    the share of toxic labels among such texts."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    del model
    give_back()             # the driver, too, has later stages to run

    def run(batches):
        # The index is built anew for each task: kept, it would take memory from later stages.
        model = sent.value
        vectors, index = Vectors(model.terms, model.by_term), BlockMaxIndex(model.weights)
        give_back()         # what building took
        for batch in batches:
            scores, evidence = [], []
            for at in range(0, len(batch), BATCH):
                found = index.nearest(vectors.rows(text_bytes(batch.slice(at, BATCH))))
                raw = votes(found, model.toxic, model.share)
                p = 1 / (1 + np.exp(-np.clip(model.slope * logit(raw) + model.intercept, -30, 30)))
                scores += np.where(np.isnan(raw), model.empty, p).tolist()
                for cosines, examples in zip(found.cosine[:, :3].tolist(),
                                             found.example[:, :3].tolist()):
                    evidence.append([{"doc_id": int(model.ids[e]), "cosine": c,
                                      "toxic": int(model.toxic[e])}
                                     for c, e in zip(cosines, examples) if c > 0])
            yield [scores, [int(s >= 0.5) for s in scores], evidence]
        del vectors, index
        give_back()

    fold = F.coalesce(crc_remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    out = append_columns(docs, ADDED.split(", ", 1)[1], run)
    names = [f"`{c}`" for c in out.columns if c.lower() not in (
        "held_out", "score", "predicted", "evidence")]
    return out.select(*names, fold.alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted to be toxic."""
    return score(docs, labels).filter("predicted = 0").select(*[f"`{c}`" for c in docs.columns])
