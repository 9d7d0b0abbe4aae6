"""Statement files read in byte ranges, for files of any size.

Spark's text source cuts a file into splits at line ends, so a large file is read by many
tasks and small ones share a task; no content is ever shuffled. What a file is (encoding,
separator and quoting, header, column roles) follows from its first lines and from flags
that one scan gathers per split. Then

* a file without quote characters is split by built-in expressions;
* a file with some is read by Python's csv module, split by split. Only there can a record
  run over a line end, and so over the end of a split. Whether a split begins inside a
  quoted field is worked out first: each split of such a file reports the state at its end
  for both states it may begin in, and a pass over a file's splits (not its lines) chains
  them. A record that lies across splits leaves them as fragments, which are put together
  in their order and read last.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.operators.skew import join_list, key_list, materialise, per_key_join
from duebook.sources.statements import (META, NEEDED, OUTPUT_ROWS, ROLE_WORDS, ROLES, SNIFF_CHARS,
                                        column_for, dialect_of)

QUOTES = {"double": b'"', "single": b"'"}
OLDER = "cp1252"
#: Of the bytes 80 to 9F, which only this encoding makes letters: the letters, and the bytes
#: that it leaves undefined.
LETTERS = {b: bytes([b]).decode(OLDER, "ignore") for b in range(0x80, 0xA0)}
NO_LETTER = [bytes([b]) for b, letter in LETTERS.items() if not letter]
BOM = b"\xef\xbb\xbf"
SPLIT = ["file_path", "block"]


def lines_under(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(file_path, block, line_id, value): the lines of the files below a folder, or of the
    named files, as bytes. Within a block (a split's first byte) line_id grows."""
    text = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root))
    return text.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").cast("binary").alias("value"))


# ------------------------------------------------------------------- facts --
SPLIT_FACTS = ("file_path string, block long, first_id long, filled long, utf8 boolean, "
               "letters boolean, nul boolean, returns boolean, double boolean, single boolean, "
               "head binary")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, line ids, lines) of each stretch of lines of one split in a batch."""
    for batch in batches:
        names = batch.schema.names
        paths, blocks = (batch.column(names.index(c)).to_pylist() for c in SPLIT)
        ids = batch.column(names.index("line_id")).to_pylist()
        lines = batch.column(names.index("value")).to_pylist()
        at = 0
        for key, same in itertools.groupby(zip(paths, blocks)):
            to = at + sum(1 for _ in same)
            yield (*key, ids[at:to], lines[at:to])
            at = to


def _gather(batches):
    facts = None
    for path, block, ids, lines in _runs(batches):
        if facts is None or (facts["file_path"], facts["block"]) != (path, block):
            if facts is not None:
                yield pa.RecordBatch.from_pylist([facts], _FACTS_ARROW)
            facts = {"file_path": path, "block": block, "first_id": ids[0], "filled": 0,
                     "utf8": True, "letters": True, "nul": False, "returns": False,
                     "double": False, "single": False, "head": b""}
        whole = b"\n".join(lines)
        try:
            whole.decode("utf-8")
        except UnicodeDecodeError:
            facts["utf8"] = False
        facts["letters"] &= not any(x in whole for x in NO_LETTER)
        facts["nul"] |= b"\0" in whole
        facts["returns"] |= b"\r" in whole.replace(b"\r\n", b"\n").removesuffix(b"\r")
        for name, quote in QUOTES.items():
            facts[name] |= quote in whole
        facts["filled"] += sum(1 for x in lines if x not in (b"", b"\r"))
        if block == 0:
            for line in lines:
                if len(facts["head"]) > SNIFF_CHARS:
                    break
                facts["head"] += line + b"\n"
    if facts is not None:
        yield pa.RecordBatch.from_pylist([facts], _FACTS_ARROW)


_FACTS_ARROW = pa.schema([
    ("file_path", pa.string()), ("block", pa.int64()), ("first_id", pa.int64()),
    ("filled", pa.int64()), *((c, pa.bool_()) for c in (
        "utf8", "letters", "nul", "returns", "double", "single")), ("head", pa.binary())])


def split_facts(lines: DataFrame) -> DataFrame:
    """One row for each split, from one scan."""
    return lines.mapInArrow(_gather, SPLIT_FACTS)


LAYOUT = ("reason string, codec string, delimiter string, spaced boolean, "
          "dialect string, places array<int>, paired boolean, scanned boolean")


def layout(head: bytes, utf8: bool, letters: bool, nul: bool, returns: bool, quotes: dict,
           filled: int) -> dict:
    """How a file is to be read, or why it is refused."""
    out = dict.fromkeys(f.split()[0] for f in LAYOUT.split(", "))
    codec = "utf-8" if utf8 else OLDER
    if not utf8 and not letters:
        return out | {"reason": "not text"}
    if nul:
        return out | {"reason": "binary"}
    text = (head.removeprefix(BOM) if utf8 else head).decode(codec, "replace")
    dialect = dialect_of(text)
    taken: list[str] = []

    def noted():
        for line in io.StringIO(text):
            taken.append(line)
            yield line

    try:
        header = next(csv.reader(noted(), dialect=dialect), [])
    except csv.Error:
        return out | {"reason": "unreadable csv"}
    named = [h for h in header if h]
    if not named:
        return out | {"reason": "no header"}
    roles = {role: column_for(named, *words) for role, words in ROLE_WORDS.items()}
    for any_of, reason in NEEDED:
        if not any(roles[role] for role in any_of):
            return out | {"reason": reason}
    if filled <= sum(1 for x in taken if x.strip("\r\n")):
        return out | {"reason": "no usable rows"}
    # Of columns with one name the last one counts.
    last = {h: at for at, h in enumerate(header)}
    quote = dialect.quotechar or '"'
    quoted = any(quotes[name] for name, q in QUOTES.items() if q.decode() == quote)
    return out | {
        "codec": codec, "delimiter": dialect.delimiter,
        "spaced": bool(dialect.skipinitialspace), "dialect": json.dumps({
            "delimiter": dialect.delimiter, "quotechar": quote,
            "doublequote": bool(dialect.doublequote),
            "skipinitialspace": bool(dialect.skipinitialspace)}),
        "places": [last[roles[r]] if roles[r] else None for r in ROLES],
        "paired": roles["amount"] is None, "scanned": quoted or returns}


def file_layouts(facts: DataFrame) -> DataFrame:
    """(file_path, first_id, splits, layout columns) of each file."""
    per_file = facts.groupBy("file_path").agg(
        *(F.bool_and(c).alias(c) for c in ("utf8", "letters")),
        *(F.bool_or(c).alias(c) for c in ("nul", "returns", "double", "single")),
        F.sum("filled").alias("filled"), F.count("*").alias("splits"),
        F.min(F.when(F.col("block") == 0, F.col("first_id"))).alias("first_id"),
        F.max("head").alias("head"))

    def run(batches):
        for pdf in batches:
            made = [layout(bytes(r.head), r.utf8, r.letters, r.nul, r.returns,
                           {"double": r.double, "single": r.single}, r.filled)
                    for r in pdf.itertuples(index=False)]
            out = pd.DataFrame(made, columns=[f.split()[0] for f in LAYOUT.split(", ")],
                               dtype=object)
            yield pd.concat([pdf[["file_path", "first_id", "splits"]].reset_index(drop=True), out],
                            axis=1)

    return per_file.mapInPandas(run, "file_path string, first_id long, splits long, " + LAYOUT)


# ------------------------------------------------------------- plain files --
def plain_fields(lines: DataFrame) -> DataFrame:
    """Fields of files without quote characters, by built-in expressions."""
    value = F.when((F.col("line_id") == F.col("first_id")) & (F.col("codec") == "utf-8")
                   & (F.substring("value", 1, 3) == F.lit(BOM)),
                   F.expr("substring(value, 4)")).otherwise(F.col("value"))
    letters = {chr(b): letter for b, letter in LETTERS.items() if letter}
    text = F.when(F.col("codec") == "utf-8", value.cast("string")).otherwise(F.translate(
        F.decode("value", "ISO-8859-1"), "".join(letters), "".join(letters.values())))
    text = F.regexp_replace(text, "\r$", "")
    fields = F.split(text, F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E")), -1)
    fields = F.when(F.col("spaced"), F.transform(fields, lambda f: F.regexp_replace(f, "^ +", ""))
                    ).otherwise(fields)
    rows = (lines.filter(F.col("line_id") != F.col("first_id"))
            .select("file_path", (F.col("block") + F.col("line_id") % 2 ** 33).alias("line_no"),
                    text.alias("text"), fields.alias("fields"), "places", "paired")
            .filter("text != ''"))
    return rows.select("file_path", "line_no", F.lit(None).cast("string").alias("reason"), *(
        F.get("fields", F.get("places", F.lit(i))).alias(f"{r}_raw")
        for i, r in enumerate(ROLES)), "paired")


# ------------------------------------------------------------ quoted files --
class Dialect:
    """Reads records, and tells whether a line leaves a quoted field open."""

    def __init__(self, settings: str, codec: str):
        self.settings = json.loads(settings)
        self.codec, self.quote = codec, self.settings["quotechar"]
        self.mark = self.quote.encode()

    def reader(self, lines: Iterable[str]):
        return csv.reader(lines, **self.settings)

    def open_after(self, line: bytes, inside: bool) -> bool:
        """Is a quoted field open at the end of `line`, beginning outside or inside one?"""
        if self.mark not in line:
            return inside
        asked = 0

        def given():
            nonlocal asked
            yield (self.quote if inside else "") + line.decode(self.codec, "replace") + "\n"
            asked = 1
            yield self.quote + "\n"

        next(self.reader(given()), None)
        return bool(asked)


def _stretches(batches, columns: list[str]):
    """(key columns, lines with their ids) of each split, its lines as they stream by."""
    def rows():
        for batch in batches:
            named = {c: batch.column(batch.schema.names.index(c)) for c in batch.schema.names}
            key = list(zip(*(named[c].to_pylist() for c in columns)))
            yield from zip(key, named["line_id"].to_pylist(), named["value"].to_pylist())

    for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield key, ((line_id, value) for _, line_id, value in group)


def _end_states(batches):
    out = []
    for (path, block, dialect, codec), lines in _stretches(
            batches, [*SPLIT, "dialect", "codec"]):
        d = Dialect(dialect, codec)
        ends = [False, True]
        for _, line in lines:
            if d.mark in line:
                try:
                    ends = [d.open_after(line, s) for s in ends]
                except csv.Error:
                    pass            # told when the records are read
        out.append((path, block, *ends))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate(
                (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
            ["file_path", "block", "outside", "inside"])
        out = []


def starting_states(lines: DataFrame) -> DataFrame:
    """(file_path, block, inside) of each split of the given lines."""
    ends = lines.select(*SPLIT, "line_id", "value", "dialect", "codec").mapInArrow(
        _end_states, "file_path string, block long, outside boolean, inside boolean")

    def chain(pdf):
        pdf = pdf.sort_values("block")
        state, states = False, []
        for outside, inside in zip(pdf["outside"], pdf["inside"]):
            states.append(state)
            state = bool(inside if state else outside)
        return pd.DataFrame({"file_path": pdf["file_path"], "block": pdf["block"],
                             "inside": states})

    return ends.groupBy("file_path").applyInPandas(
        chain, "file_path string, block long, inside boolean")


FIELDS = ("file_path string, line_no long, reason string, "
          + ", ".join(f"{r}_raw string" for r in ROLES) + ", paired boolean, "
          "block long, part string, content binary")
LEAD, TAIL = "lead", "tail"
HOW = ["dialect", "codec", "places", "paired"]


class Records:
    """Rows of FIELDS, in frames of bounded size."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, path, line_no, fields, places, paired):
        self.rows.append((path, line_no, None, *(
            fields[p] if p is not None and p < len(fields) else None for p in places), paired,
            None, None, None))

    def refuse(self, path, reason):
        self.rows.append((path, None, reason, *[None] * len(ROLES), None, None, None, None))

    def fragment(self, path, line_no, block, part, content, paired):
        self.rows.append((path, line_no, None, *[None] * len(ROLES), paired, block, part, content))

    def frame(self):
        out = pd.DataFrame(self.rows, columns=[f.split()[0] for f in FIELDS.split(", ")],
                           dtype=object)
        self.rows = []
        return pa.RecordBatch.from_pandas(out, _FIELDS_ARROW, preserve_index=False)


_FIELDS_ARROW = pa.schema([
    ("file_path", pa.string()), ("line_no", pa.int64()), ("reason", pa.string()),
    *((f"{r}_raw", pa.string()) for r in ROLES), ("paired", pa.bool_()), ("block", pa.int64()),
    ("part", pa.string()), ("content", pa.binary())])


def _read_split(key, lines, out: Records):
    """Records of one split; what belongs to a record across its ends goes as fragments."""
    path, block, first_id, inside, dialect, codec, places, paired = key
    d = Dialect(dialect, codec)
    lead = []
    while inside:
        line_id, line = next(lines, (None, None))
        if line is None:
            break
        lead.append(line)
        inside = d.open_after(line, True)
    if lead:
        out.fragment(path, None, block, LEAD, b"\n".join(lead) + b"\n", paired)
    held: list[bytes] = []
    at = 0

    def given():
        nonlocal at
        for line_id, line in lines:
            if line_id == first_id and codec == "utf-8":
                line = line.removeprefix(BOM)
            if not held:
                at = block + line_id % 2 ** 33
            held.append(line)
            yield line.decode(codec) + "\n"
        # A record that asks for more than the split has is left to the fragments.
        ended.append(True)

    ended: list[bool] = []
    number = 0
    for fields in d.reader(given()):
        if ended:
            break
        held.clear()
        number += 1
        if fields and not (block == 0 and number == 1):
            out.add(path, at, fields, places, paired)
        if len(out.rows) >= OUTPUT_ROWS:
            yield out.frame()
    if held:
        out.fragment(path, at, block, TAIL, b"\n".join(held) + b"\n", paired)


def _read_splits(batches):
    out = Records()
    columns = [*SPLIT, "first_id", "inside", *HOW]

    def keyed():
        for batch in batches:
            named = {c: batch.column(batch.schema.names.index(c)).to_pylist()
                     for c in batch.schema.names}
            named["places"] = [tuple(p) for p in named["places"]]
            key = zip(*(named[c] for c in columns))
            yield from zip(key, named["line_id"], named["value"])

    for key, group in itertools.groupby(keyed(), key=lambda r: r[0]):
        try:
            yield from _read_split(key, ((i, v) for _, i, v in group), out)
        except csv.Error:
            out.refuse(key[0], "unreadable csv")
        if len(out.rows) >= OUTPUT_ROWS:
            yield out.frame()
    yield out.frame()


def _join_fragments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Records that lie across the splits of one file, each from its tail on."""
    out = Records()
    pdf = pdf.sort_values(["block", "part"], kind="stable")     # a split's lead before its tail
    path, how = pdf["file_path"].iloc[0], pdf.iloc[0]
    d, places = Dialect(how["dialect"], how["codec"]), list(how["places"])
    places = [None if p is None or p != p else int(p) for p in places]
    starts = [k for k, part in enumerate(pdf["part"]) if part == TAIL] + [len(pdf)]
    for a, b in zip(starts, starts[1:]):
        content = b"".join(bytes(c) for c in pdf["content"].iloc[a:b])
        lines = [x + "\n" for x in content.decode(d.codec).split("\n")[:-1]]
        try:
            for fields in d.reader(lines):
                if fields:
                    out.add(path, int(pdf["line_no"].iloc[a]), fields, places, how["paired"])
        except csv.Error:
            out.refuse(path, "unreadable csv")
    return out.frame().to_pandas()


def scanned_fields(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Fields of files with quote characters. `lines` have the layouts' columns."""
    several = lines.filter("splits > 1")
    states = materialise(starting_states(several))
    listed = key_list(states.filter("inside"), SPLIT)
    # Of all splits only those that begin inside a field are looked up.
    inside = listed.rows.withColumn("inside", F.lit(True))
    both = (lines.join(F.broadcast(inside), SPLIT, "left") if listed.short
            else per_key_join(lines, inside, SPLIT, ["line_id"], "left")
            .repartition(*SPLIT).sortWithinPartitions(*SPLIT, "line_id"))
    both = both.withColumn("inside", F.coalesce("inside", F.lit(False)))
    read = materialise(both.select(*SPLIT, "line_id", "value", "first_id", "inside", *HOW
                                   ).mapInArrow(_read_splits, FIELDS))
    parts = read.filter("part is not null").drop("paired", *(f"{r}_raw" for r in ROLES))
    crossing = (parts.join(layouts.select("file_path", *HOW), "file_path")
                .groupBy("file_path").applyInPandas(_join_fragments, FIELDS))
    return (read.filter("part is null").unionByName(crossing).drop("block", "part", "content"))


# --------------------------------------------------------------------- read --
def read_fields(files: DataFrame, root: str | list[str]) -> DataFrame:
    """The rows ``statements.split_files`` gives, for `files` (META and file_path, content not
    looked at) that lie below `root` or are named in it."""
    lines = lines_under(files.sparkSession, root)
    facts = materialise(join_list(split_facts(lines), key_list(files, ["file_path"]),
                                  ["file_path"], "left_semi"))
    layouts = materialise(file_layouts(facts))
    good = materialise(layouts.filter("reason is null").drop("reason"))
    if key_list(good, ["file_path"]).short:
        known = lines.join(F.broadcast(good), "file_path")
    else:
        known = per_key_join(lines, good, ["file_path"], ["line_id"]).repartition(
            *SPLIT).sortWithinPartitions(*SPLIT, "line_id")
    fields = plain_fields(known.filter("not scanned"))
    if not good.filter("scanned").isEmpty():
        scanned = materialise(scanned_fields(known.filter("scanned"), good))
        broken = key_list(scanned.filter("reason is not null"), ["file_path"])
        # A file with one unreadable record is refused whole.
        whole = join_list(scanned, broken, ["file_path"], "left_anti")
        fields = fields.unionByName(whole).unionByName(
            blank(broken.rows.withColumn("reason", F.lit("unreadable csv"))))
    empty = files.select("file_path").join(layouts.select("file_path"), "file_path", "left_anti")
    refused = layouts.filter("reason is not null").select("file_path", "reason").unionByName(
        empty.withColumn("reason", F.lit("empty")))
    fields = fields.unionByName(blank(refused))
    meta = files.select("file_path", *META)
    joined = (fields.join(F.broadcast(meta), "file_path")
              if key_list(meta, ["file_path"]).short
              else per_key_join(fields, meta, ["file_path"], ["line_no"]))
    return joined.select(*META, "line_no", "reason", *(f"{r}_raw" for r in ROLES), "paired")


def blank(refused: DataFrame) -> DataFrame:
    none = F.lit(None)
    return refused.select("file_path", none.cast("long").alias("line_no"), "reason", *(
        none.cast("string").alias(f"{r}_raw") for r in ROLES), none.cast("boolean").alias("paired"))
