"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.operators.skew import materialise

SPACE = b" \t\n\x0b\x0c\r"
BROADCAST_ROWS = 1_000_000
BATCH_BYTES = 8 * 2 ** 20


def bounded_batches(spark) -> None:
    """Whole texts reach Python in batches of at most BATCH_BYTES or one row: of Spark's usual
    batches, of 10,000 rows, each task holds tens of MB twice, in the JVM and in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark, sf_dir: str, table: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; -1 where there is no id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)),
                      F.lit(-1)).cast("int")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without columns of these names; Spark's names ignore case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of `df` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def append_columns(df: DataFrame, added: str,
                   make: Callable[[Iterator[pa.RecordBatch]], Iterator[list]],
                   consumed: tuple[str, ...] = ()) -> DataFrame:
    """`df` with columns that Python works out from Arrow batches. `make` gets the
    batches and yields, batch by batch, one list or array for each added column.
    Columns of `df` that have an added column's name are replaced; `consumed` ones are
    seen by `make` only."""
    fields = T.StructType.fromDDL(added).fields
    source = without(df, [f.name for f in fields if f.name not in consumed])
    passed = [i for i, c in enumerate(source.columns) if c not in consumed]
    schema = T.StructType([source.schema.fields[i] for i in passed] + fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(f.dataType) for f in fields]
        names = [f.name for f in schema.fields]
        seen: list[pa.RecordBatch] = []

        def noted():
            for batch in batches:
                seen.append(batch)
                yield batch

        for columns in make(noted()):
            batch = seen.pop(0)
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t)
                      for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in passed], *arrays], names)

    return source.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system, where the C library can. Python workers outlive
    their tasks, and what they keep lessens what the next stage has."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write `df` once and count it: up to `limit` rows are marked for a broadcast,
    more are left to a shuffled join."""
    rows = materialise(df)
    return F.broadcast(rows) if rows.count() <= limit else rows


def starred(pairs: DataFrame) -> bool:
    """Whether in pairs (a, b) no node has two b, and no b is an a."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ).alias("e")).select("e.*")
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.filter("up > 1 or up = 1 and down = 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b), root being the component's least
    node. Large-star and small-star rounds (Kiveris et al., 2014): each is a grouped
    minimum and a join, written once, until all are stars; edges that are stars already,
    as those of an earlier result, take none. No neighbour list is gathered anywhere."""
    def stars(pairs):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        return (large.join(least, "a")
                .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                          F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
                                          )).alias("e"))
                .select("e.a", "e.b").filter("a != b").distinct())

    pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a != b").distinct())
    while not starred(pairs):
        pairs = materialise(stars(pairs))
    return (pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
