"""Ordered folds over groups of any length.

Some rules need each row's outcome before the next row can be judged (a price
level, a rate limit that forgets refused attempts). Rows are sorted per group by
Spark and streamed through a small step object; a group is never held in memory.

A group longer than ``split_rows`` is cut into consecutive chunks that run in
parallel, in rounds. A chunk reports what it adds to the state (its tail); chaining
the tails gives every chunk the state to start from in the next round, and rounds
repeat until no starting state changes. The first chunk is right in round one, so
chunk c is right by round c+1 at the latest and the fixpoint is the sequential
result. Usually two or three rounds do, since a chunk's tail seldom depends on much
of what came before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from duebook.operators.skew import by_python_key, materialise

STATE, ROW, AHEAD = 0, 1, 2
SPLIT_ROWS = 200_000


def _runner(step: Callable, keys: int, order: int, width: int, columns: list[str],
            end_states: bool):
    """mapInPandas body. Input columns: keys, _chunk, _kind, fields, _state.
    `step(state)` makes a folder with ``feed(row, next_row) -> result tuple`` and
    ``tail() -> str``; rows are the tuples of the field columns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, folder, waiting = None, None, None
        at = keys + 2
        for pdf in batches:
            out = []
            for rec in zip(*(pdf[c].tolist() for c in pdf.columns)):
                key = rec[:keys + 1]
                if key != group:
                    if waiting is not None:
                        out.append((*group, ROW, *waiting, *folder.feed(waiting, None), None))
                    if group is not None and end_states:
                        out.append((*group, STATE, *blank, folder.tail()))
                    group, folder, waiting = key, step(None), None
                    blank = (None,) * (width + folder.results)
                kind, row = rec[keys + 1], rec[at:at + width]
                if kind == STATE:
                    folder = step(rec[-1])
                    continue
                if waiting is not None:
                    out.append((*group, ROW, *waiting, *folder.feed(waiting, row), None))
                waiting = row if kind == ROW else None
            yield pd.DataFrame(out, columns=columns, dtype=object)
        if group is not None:
            out = []
            if waiting is not None:
                out.append((*group, ROW, *waiting, *folder.feed(waiting, None), None))
            if end_states:
                out.append((*group, STATE, *blank, folder.tail()))
            yield pd.DataFrame(out, columns=columns, dtype=object)
    return run


def _chainer(step: Callable, keys: int):
    """Starting states of all chunks of one group from the tails of all."""
    def run(tails: pd.DataFrame) -> pd.DataFrame:
        tails = tails.sort_values("_before")
        state, out = None, []
        for rec in zip(*(tails[c].tolist() for c in tails.columns)):
            state = step.chain(state, rec[-1])
            if rec[keys + 1] is not None and rec[keys + 1] == rec[keys + 1]:
                out.append((*rec[:keys], int(rec[keys + 1]), state))
        return pd.DataFrame(out, columns=[*tails.columns[:keys], "_chunk", "_state"])
    return run


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], step: Callable,
                results: str, units: list[Column], split_rows: int | None = SPLIT_ROWS
                ) -> DataFrame:
    """Fold `rows` per `keys` in `order`; returns the rows with the `results`
    columns ("name type, ...") added.

    Fields are numbers, booleans or text. `order` columns must decide the order up to equal rows. `units` are expressions
    that only grow along `order` and take a bounded number of values per group
    (a day, a day and a price band): chunks are made of whole units.
    """
    fields = [c for c in rows.columns if c not in keys]
    schema = rows.schema
    added = StructType.fromDDL(results)

    def fold(chunked: DataFrame, end_states: bool) -> DataFrame:
        out = StructType([*(schema[k] for k in keys), StructField("_chunk", IntegerType()),
                          StructField("_kind", IntegerType()), *(schema[f] for f in fields),
                          *added, StructField("_state", StringType())])
        out = StructType([StructField(f.name, f.dataType) for f in out])
        body = _runner(step, len(keys), len(order), len(fields), out.names, end_states)
        return (by_python_key(chunked.select(*keys, "_chunk", "_kind", *fields, "_state"),
                              [*keys, "_chunk"])
                .sortWithinPartitions(*keys, "_chunk", "_kind", *order)
                .mapInPandas(body, out))

    def as_rows(df: DataFrame, chunk) -> DataFrame:
        return (df.withColumn("_chunk", chunk).withColumn("_kind", F.lit(ROW))
                .withColumn("_state", F.lit(None).cast("string")))

    plain = [*rows.columns, *added.names]
    if split_rows is None:
        return fold(as_rows(rows, F.lit(0)), False).select(*plain)
    hot = (rows.groupBy(*keys).agg(F.count("*").alias("_n"))
           .filter(F.col("_n") > split_rows).select(*keys))
    if hot.isEmpty():
        return fold(as_rows(rows, F.lit(0)), False).select(*plain)

    # At most total/split_rows groups are hot, so this side of the joins is small.
    hot = materialise(hot)
    short = fold(as_rows(rows.join(hot, keys, "left_anti"), F.lit(0)), False).select(*plain)

    named = [u.alias(f"_u{i}") for i, u in enumerate(units)]
    unit = [f"_u{i}" for i in range(len(units))]
    long = rows.join(hot, keys, "left_semi").select("*", *named)
    running = (Window.partitionBy(*keys).orderBy(*unit)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chunks = (long.groupBy(*keys, *unit).agg(F.count("*").alias("_n"))
              .withColumn("_chunk", F.floor((F.sum("_n").over(running) - F.col("_n"))
                                            / split_rows).cast("int"))
              .select(*keys, *unit, "_chunk"))
    long = materialise(as_rows(long.join(chunks, [*keys, *unit]).drop(*unit), F.col("_chunk")))
    order_first = [*order, *(f for f in fields if f not in order)]
    heads = (long.groupBy(*keys, "_chunk").agg(F.min(F.struct(*order_first)).alias("_h"))
             .withColumn("_before", F.lag("_chunk").over(
                 Window.partitionBy(*keys).orderBy("_chunk"))))
    links = materialise(heads.filter("_before is not null"))
    ahead = links.select(*keys, F.col("_before").alias("_chunk"), F.lit(AHEAD).alias("_kind"),
                         *(F.col(f"_h.{f}").alias(f) for f in fields),
                         F.lit(None).cast("string").alias("_state"))
    stream = long.select(*ahead.columns).unionByName(ahead)
    # Zeros, not NULLs: one NULL would turn a whole batch of integers into floats.
    empty = [F.lit(0).cast(schema[f].dataType).alias(f) for f in fields]

    def with_states(states: DataFrame | None) -> DataFrame:
        if states is None:
            return stream
        return stream.unionByName(states.select(
            *keys, "_chunk", F.lit(STATE).alias("_kind"), *empty, "_state"))

    chained = StructType([*(StructField(k, schema[k].dataType) for k in keys),
                          StructField("_chunk", IntegerType()), StructField("_state", StringType())])
    states = None
    while True:
        folded = fold(with_states(states), True)
        tails = folded.filter(F.col("_kind") == STATE).select(
            *keys, F.col("_chunk").alias("_before"), "_state")
        linked = tails.join(links.select(*keys, "_before", "_chunk"), [*keys, "_before"], "left")
        fresh = materialise(linked.select(*keys, "_before", "_chunk", "_state").groupBy(*keys)
                            .applyInPandas(_chainer(step, len(keys)), chained))
        if states is not None and fresh.exceptAll(states).isEmpty():
            break
        states = fresh
    settled = fold(with_states(states), False).filter(F.col("_kind") == ROW).select(*plain)
    return short.unionByName(settled)
