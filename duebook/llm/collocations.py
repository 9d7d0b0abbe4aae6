"""Phrase collocations from count streams that are merged in prefix and in suffix order.

Phrases of one to four words are counted level by level: a phrase can only be frequent if
both phrases one word shorter that it holds are, so a task sends a phrase only where a bit
array of fixed size has both. The array lets some others through; the counts are exact.

The frequent phrases and their counts then form two streams, as in the external estimation of
language models: one in prefix order, in which a phrase directly follows the phrases it
begins with, one in suffix order (words reversed). A pass along a stream keeps the phrases
that are open at a row in a stack of at most four: they are the row's first parts, and the
row is an extension of the one below it. So one pass over each order gives every phrase the
counts of its first and its last parts and its most frequent extension to either side; no
table of counts is held anywhere, and the two passes meet in a merge join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm import bitfilter
from duebook.llm.common import materialise, small_side
from duebook.llm.words import Texts, slices
from duebook.operators.skew import top_rows

MOST = 4                # words of the longest phrase
LEAST = 30              # occurrences of a phrase
SCALE = 2_000_000
COVER = 80              # per cent of a phrase's occurrences inside a longer one
TOP = 2000
UNKNOWN = "und"
HOT_PHRASES = 1_000_000

#: Ends of pieces become line feeds, tabs blanks, letters A-Z lower case.
TABLE = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r" + bytes(range(65, 91)),
                        b" " + b"\n" * 10 + bytes(range(97, 123)))


# ------------------------------------------------------------------ counting --
def mixed(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its first words and its last word's."""
    value = (value ^ word) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def phrase_hashes(seed: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    for word in words:
        seed = mixed(seed, word)
    return seed


def lang_hashes(langs) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), seed=1) for x in langs], dtype=np.uint64)


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each occurs."""
    rank = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        _, rank = np.unique(rank * (int(column.max(initial=0)) + 1) + column, return_inverse=True)
    _, first, n = np.unique(rank, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def level_counts(docs: DataFrame, size: int, shorter: np.ndarray | None, bits: int) -> DataFrame:
    """(lang, phrase, n) of all phrases of `size` words both of whose shorter phrases the bit
    array may hold."""
    sent = None if shorter is None else docs.sparkSession.sparkContext.broadcast(shorter)

    def counts(langs, texts):
        there = Texts(texts, TABLE)
        numbers, spellings = there.numbered()
        n = max(0, len(numbers) - size + 1)
        pieces = there.pieces()
        at = np.flatnonzero(pieces[:n] == pieces[size - 1:size - 1 + n])
        names = sorted(set(langs))
        place = {lang: k for k, lang in enumerate(names)}
        owner = np.array([place[x] for x in langs])[there.owners()]
        if sent is not None:
            seeds = lang_hashes(names)[owner[at]]
            own = [there.hashes[at + i] for i in range(size)]
            kept = bitfilter.held(sent.value, phrase_hashes(seeds, own[:-1]), bits)
            kept &= bitfilter.held(sent.value, phrase_hashes(seeds, own[1:]), bits)
            at = at[kept]
        (owner, *parts), n = counted([owner[at], *[numbers[at + i] for i in range(size)]])
        known = pa.array(spellings, pa.binary())
        columns = [known.take(pa.array(p)) for p in parts]
        phrases = (columns[0] if size == 1 else
                   pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())))
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(owner)), phrases.cast(pa.string()),
             pa.array(n)], ["lang", "phrase", "n"])

    def run(batches):
        for rows, texts in slices(batches):
            yield counts(rows.column(1).to_pylist(), texts)

    rows = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    return (rows.mapInArrow(run, "lang string, phrase string, n long")
            .groupBy("lang", "phrase").agg(F.sum("n").alias("n")))


def phrase_bits(frequent: DataFrame, size: int, bits: int) -> np.ndarray:
    """The bit array of phrases of `size` words."""
    def run(batches):
        for batch in batches:
            phrases = batch.column(1).cast(pa.binary()).to_pylist()
            words = Texts(phrases, TABLE).hashes.reshape(len(phrases), size)
            hashes = phrase_hashes(lang_hashes(batch.column(0).to_pylist()), list(words.T))
            yield pa.RecordBatch.from_arrays([pa.array(bitfilter.slots(hashes, bits))], ["slot"])

    return bitfilter.collected(frequent.select("lang", "phrase").mapInArrow(run, "slot long"), bits)


def count_streams(docs: DataFrame, most: int, least: int, bits: int) -> tuple:
    """(lang, n) of all words, and (lang, phrase, size, n) of the phrases of up to `most`
    words that occur `least` times or more, each level written once."""
    words = materialise(level_counts(docs, 1, None, bits))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    levels = [materialise(words.filter(F.col("n") >= least))]
    for size in range(2, most + 1):
        array = phrase_bits(levels[-1], size - 1, bits)
        levels.append(materialise(level_counts(docs, size, array, bits)
                                  .filter(F.col("n") >= least)))
    stream = levels[0].withColumn("size", F.lit(1))
    for size, level in enumerate(levels[1:], 2):
        stream = stream.unionByName(level.withColumn("size", F.lit(size)))
    return totals, stream


# ------------------------------------------------------------ merged streams --
def merged(stream: DataFrame, backwards: bool, hot: int = HOT_PHRASES) -> DataFrame:
    """(lang, phrase, n, parts, extension) of each phrase of two words or more, from one pass
    in prefix order, or in suffix order: the counts of the parts it begins (or ends) with,
    by their size, and of its most frequent extension by a word at the other end.

    Phrases of a common first word make a hot group; one of more than `hot` phrases is dealt
    by the second word, and the row of the word itself goes to every part."""
    words = F.split("phrase", " ")
    rows = stream.withColumn("words", F.reverse(words) if backwards else words)
    rows = rows.withColumn("head", F.col("words")[0])
    heads = (rows.groupBy("lang", "head").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)
             .select("lang", "head", F.ceil(F.col("_n") / hot).cast("int").alias("salts")))
    # At most total / hot groups are hot.
    rows = rows.join(F.broadcast(heads), ["lang", "head"], "left").withColumn(
        "salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.explode(
        F.when(F.col("size") == 1, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
            F.array(F.pmod(F.xxhash64(F.get("words", F.lit(1))), F.col("salts")).cast("int")))))
    tasks = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (rows.repartition(tasks, "lang", "head", "salt")
            .sortWithinPartitions("lang", "salt", "words")
            .select("lang", "salt", "words", "phrase", "n"))

    def run(batches):
        # [(lang, salt), words, phrase, n, extension]; each row begins the next.
        open_rows: list = []
        out: list = []

        def close():
            group, own, phrase, n, extension = open_rows.pop()
            if len(own) > 1:
                out.append((group[0], phrase, n, [r[3] for r in open_rows], extension))

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()))],
                ["lang", "phrase", "n", "parts", "extension"])

        for batch in batches:
            for lang, salt, own, phrase, n in zip(*(c.to_pylist() for c in batch.columns)):
                while open_rows and (open_rows[-1][0] != (lang, salt)
                                     or own[:len(open_rows[-1][1])] != open_rows[-1][1]):
                    close()
                if open_rows:
                    open_rows[-1][4] = max(open_rows[-1][4], n)
                open_rows.append([(lang, salt), own, phrase, n, 0])
            yield made()
            out.clear()
        while open_rows:
            close()
        yield made()

    return rows.mapInArrow(
        run, "lang string, phrase string, n long, parts array<long>, extension long")


def scored(stream: DataFrame, totals: DataFrame, scale: int, cover: int,
           hot: int = HOT_PHRASES) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer
    one covers. A longer phrase holds an extension by one word, which occurs as often or more,
    so these decide."""
    left = merged(stream, False, hot)
    right = merged(stream, True, hot).select(
        "lang", "phrase", F.col("parts").alias("last"), F.col("extension").alias("before"))
    both = left.hint("merge").join(right, ["lang", "phrase"])

    def wide(c: str) -> str:
        return f"cast({c} as decimal(20,0))"

    both = both.withColumn("longer", F.greatest("extension", "before")).filter(
        f"{wide('longer')} * 100 < {wide('n')} * {cover}")
    # parts[i] counts the first i + 1 words, rest the others.
    rest = "last[size(last) - 1 - i]"
    both = both.withColumn("cut", F.expr(f"""array_min(transform(parts, (part, i) -> struct(
        {wide('n')} * {scale} div ({wide('part')} + {wide(rest)}) as score,
        i + 1 as k, part as l, {rest} as r)))"""))
    return both.join(small_side(totals), "lang").select(
        "lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"),
        "cut.score")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, scale: int = SCALE,
                 cover: int = COVER, top: int = TOP, bits: int = bitfilter.BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and pieces into
    words at blanks and tabs. A phrase of 2 to `most` words that occurs a >= `least` times is
    scored by its worst cut, floor(`scale` a / (l + r)), l and r being the counts of the two
    sides (of equally bad cuts the first). Phrases of which a longer one has `cover` per cent
    of the occurrences or more are dropped. Order: score, count, phrase (by bytes).

    A null text has no words, a null lang is `und`; repeated rows count as often as they
    are there, and columns other than text and lang are not looked at. An empty table, or
    one without frequent phrases, gives no rows."""
    totals, stream = count_streams(docs, most, least, bits)
    found = scored(stream, totals, scale, cover)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_rows(found, ["lang"], order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return ranked.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
