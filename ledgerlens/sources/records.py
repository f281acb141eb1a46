"""Records of large CSV and JSON files, read by many tasks wherever the file is cut.

A file system cuts a file into blocks without regard to records: a block may begin inside quotes or inside a nested
object. What a scanner would know at a block's start follows from what the earlier blocks do to its state, and the
effects combine: quote marks add up to a parity, brackets to a depth (one for either parity). So one pass reduces
each block to its effect, a running sum over the few rows of a file's blocks gives every block its starting state, and
a second pass cuts all blocks into records at once. Records that cross a block's edge leave as fragments, at most two a
block, and only these are shuffled to be joined.

Pieces are the parts of a file between line breaks (CSV) or closing braces (JSON), as Spark's text reader splits them. The starting states are
broadcast: a row for each block, so 100 TB in blocks of 128 MB are 800,000 rows.

CSV: quotes inside quotes are doubled and no unquoted field holds a quote mark. Line breaks inside quotes are kept as they are.
JSON: a file is an array of objects, or objects one behind the other, over as many or as few lines as it likes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

BLOCK = ["file", "block"]
_NAMES = "file string, block long, turn int, kind string, first boolean, text string"
# What a column's texts may be, the narrowest first, and the shape of each.
TEXT_TYPES = (
    ("int", r"^[+-]?\d{1,10}$"),
    ("bigint", r"^[+-]?\d{1,19}$"),
    ("decimal(38,0)", r"^[+-]?\d{1,38}$"),
    ("double", None),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"),
    ("boolean", r"^(?i)(true|false)$"),
)


def split_bytes(spark: SparkSession) -> int:
    """Bytes of a file that one task reads at most."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", text).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def needs_splitting(spark: SparkSession, path: str | list[str], **options) -> bool:
    """Whether some file is larger than a task's share; contents are not read."""
    kept = {k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")}
    sizes = spark.read.format("binaryFile").options(**kept).load(path)
    return (sizes.agg(F.max("length")).first()[0] or 0) > split_bytes(spark)


def _pieces(spark: SparkSession, path: str | list[str], sep: str, options: dict) -> DataFrame:
    """file, block, piece; a block's pieces come in the order of the file."""
    kept = {k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")}
    text = spark.read.options(**kept).option("lineSep", sep).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def _earlier(value: Column) -> Column:
    return F.coalesce(F.sum(value).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """File, block, first row and end of each run of rows of one block."""
    files, blocks = batch.column("file").to_pylist(), np.array(batch.column("block"))
    edges = [0, *(np.flatnonzero(np.diff(blocks) != 0) + 1).tolist(), len(blocks)]
    # Neighbouring files may both start at 0.
    edges = sorted({*edges, *(i for i in range(1, len(files)) if files[i] is not files[i - 1] and files[i] != files[i - 1])})
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield files[a], int(blocks[a]), a, b


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(name), np.int64)


def _depths(quotes: np.ndarray, outside: np.ndarray, inside: np.ndarray, parity: int, closing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Parity behind each piece, and what each piece does to the depth, when the first one starts with that parity.

    With closing, a piece ends in a closing brace, which counts unless it stands in quotes.
    """
    after = (parity + np.cumsum(quotes)) % 2
    before = (after - quotes) % 2
    return after, np.where(before == 0, outside, inside) - ((after == 0) & closing)


def _effects(pieces: DataFrame) -> DataFrame:
    """Per block: its number of quotes, its effect on the depth from either parity, whether it begins with a bracket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            quotes, outside, inside = (_ints(batch, c) for c in ("quotes", "outside", "inside"))
            for file, block, a, b in _by_block(batch):
                if (file, block) not in out:
                    array = (batch.column("piece")[a].as_py() or "").lstrip("\ufeff \t\r\n").startswith("[")
                    out[file, block] = [0, 0, 0, int(array)]
                state = out[file, block]
                for start in (0, 1):
                    _, depth = _depths(quotes[a:b], outside[a:b], inside[a:b], (start + state[0]) % 2, True)
                    state[1 + start] += int(depth.sum())
                state[0] += int(quotes[a:b].sum())
        rows = [(*k, *v) for k, v in out.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "block", "quotes", "depth0", "depth1", "array"])

    return pieces.mapInArrow(run, "file string, block long, quotes long, depth0 long, depth1 long, array long")


def _cut(pieces: DataFrame, sep: str, mark: str) -> DataFrame:
    """Whole records and fragments of every block; pieces carry the block's start (parity, depth, level).

    A record ends behind a piece that leaves the scanner outside quotes at the level of the records. mark is what
    the reader took away at the end of a record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        parity = depth = level = 0
        held: list[str] = []
        open_start = first = False

        def rest() -> list[tuple]:
            """What a block leaves open at its end."""
            if not held:
                return []
            kind = "middle" if open_start else "head"
            return [(*now, 0 if open_start else 1, kind, first, sep.join(held))]

        for batch in batches:
            texts = batch.column("piece").to_pylist()
            quotes, outside, inside = (_ints(batch, c) for c in ("quotes", "outside", "inside"))
            out: list[tuple] = []
            for file, block, a, b in _by_block(batch):
                if (file, block) != now:
                    out += rest()
                    now, held = (file, block), []
                    parity, depth, level = (int(batch.column(c)[a].as_py()) for c in ("parity", "depth", "level"))
                    open_start, first = bool(parity) or depth > level, block == 0
                after, change = _depths(quotes[a:b], outside[a:b], inside[a:b], parity, bool(mark))
                depths = depth + np.cumsum(change)
                ends = np.flatnonzero((after == 0) & (depths == level)) + a + 1
                at = a
                for end in ends.tolist():
                    text = sep.join([*held, *texts[at:end]])
                    if open_start:
                        out.append((file, block, 0, "tail", False, text))
                    else:
                        out.append((file, block, 0, "whole", first, text + mark))
                    held, at, open_start, first = [], end, False, False
                held += texts[at:b]
                parity, depth = int(after[-1]), int(depths[-1])
            if out:
                yield _rows(out)
        if out := rest():
            yield _rows(out)

    return pieces.mapInArrow(run, _NAMES)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in _NAMES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _joined(cut: DataFrame, sep: str, mark: str) -> DataFrame:
    """text and first of every record; fragments of one record meet by the number of heads before them in the file."""
    whole = cut.where("kind = 'whole'").select("text", "first")
    order = W.partitionBy("file").orderBy("block", "turn").rowsBetween(W.unboundedPreceding, 0)
    parts = cut.where("kind <> 'whole'").withColumn("record", F.count_if(F.col("kind") == "head").over(order))
    together = parts.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "turn", "text"))).alias("p"), F.bool_or("first").alias("first"),
        F.bool_or(F.col("kind") == "tail").alias("closed"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), sep)
    return whole.unionByName(together.select(F.when(F.col("closed"), F.concat(text, F.lit(mark))).otherwise(text).alias("text"), "first"))


def csv_records(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """text and first (whether it is a file's first) of every record of CSV files; blank lines are no records."""
    pieces = _pieces(spark, path, "\n", options)
    count = F.length("piece") - F.length(F.replace("piece", F.lit('"'), F.lit("")))
    pieces = pieces.withColumn("quotes", count)
    starts = pieces.groupBy(*BLOCK).agg(F.sum("quotes").alias("quotes"))
    starts = starts.select(*BLOCK, (_earlier(F.col("quotes")) % 2).alias("parity"))
    zero = F.lit(0).cast("long")
    read = pieces.join(F.broadcast(starts), BLOCK).select(
        *BLOCK, "piece", "quotes", "parity", *[zero.alias(c) for c in ("outside", "inside", "depth", "level")])
    found = _joined(_cut(read, "\n", ""), "\n", "")
    text = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "^\ufeff", "")
    return found.select(text.alias("text"), "first").where(F.length(F.trim("text")) > 0)


def json_records(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """text of every object of JSON files."""
    plain = F.regexp_replace("piece", r"\\.", "")
    pieces = _pieces(spark, path, "}", options).withColumn("parts", F.split(plain, '"', -1))

    def effect(turn: int) -> Column:
        outer = F.array_join(F.filter("parts", lambda _, i: i % 2 == turn), "")
        return F.length(F.regexp_replace(outer, r"[^\[{]", "")) - F.length(F.regexp_replace(outer, r"[^\]]", ""))

    pieces = pieces.select(*BLOCK, "piece", (F.size("parts") - 1).alias("quotes"), effect(0).alias("outside"), effect(1).alias("inside"))
    starts = _effects(pieces).withColumn("parity", _earlier(F.col("quotes")) % 2)
    starts = starts.withColumn("change", F.when(F.col("parity") == 0, F.col("depth0")).otherwise(F.col("depth1")))
    level = F.first("array").over(W.partitionBy("file").orderBy("block"))
    starts = starts.select(*BLOCK, "parity", _earlier(F.col("change")).alias("depth"), level.alias("level"))
    read = pieces.join(F.broadcast(starts), BLOCK)
    found = _joined(_cut(read, "}", "}"), "}", "}")
    text = F.regexp_replace("text", r"^[\ufeff\s,\[]+", "")
    return found.select(text.alias("text")).where(F.startswith("text", F.lit("{")))


def ddl(schema: T.StructType | str) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def distinct_names(names: list[str]) -> list[str]:
    """Repeated and empty names get their place."""
    lower = [n.lower() for n in names]
    return [n + str(i) if lower.count(n.lower()) > 1 else n or f"_c{i}" for i, n in enumerate(names)]


def text_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type of each text column that all its values have, in one pass."""
    checks = []
    for i, c in enumerate(df.columns):
        for k, (kind, shape) in enumerate(TEXT_TYPES):
            col = F.col(f"`{c}`")
            fits = col.try_cast(kind).isNotNull()
            fits = fits if shape is None else fits & col.rlike(shape)
            checks.append(F.bool_and(col.isNull() | fits).alias(f"c{i}_{k}"))
        checks.append(F.count(F.col(f"`{c}`")).alias(f"n{i}"))
    row = df.agg(*checks).first()
    out = {}
    for i, c in enumerate(df.columns):
        fit = [kind for k, (kind, _) in enumerate(TEXT_TYPES) if row[f"c{i}_{k}"]]
        out[c] = fit[0] if fit and row[f"n{i}"] else "string"
    return out


def read_csv(spark: SparkSession, path: str | list[str], header: list[str], schema=None, **options) -> DataFrame:
    """CSV files with a header line, read by block. Without a schema the types come from the texts, in another pass."""
    records = csv_records(spark, path, **options).where("NOT first").select("text")
    names = distinct_names(header)
    parse = {k: v for k, v in options.items() if k in ("sep", "quote", "escape", "nullValue", "emptyValue", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "dateFormat", "timestampFormat")}
    parse = {k: str(v).lower() if isinstance(v, bool) else v for k, v in parse.items()} | {"multiLine": "true", "maxCharsPerColumn": "-1"}
    wanted = ddl(schema) if schema is not None else ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    df = records.select(F.from_csv("text", wanted, parse).alias("r")).select("r.*")
    if schema is not None:
        return df
    kinds = text_types(df)
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in df.columns])


def read_json(spark: SparkSession, path: str | list[str], schema=None, **options) -> DataFrame:
    """JSON files of objects, read by block. Without a schema the types come from all objects, in another pass."""
    records = json_records(spark, path, **options)
    if schema is None:
        found = records.agg(F.schema_of_variant_agg(F.try_parse_json("text"))).first()[0] or "VOID"
        found = re.sub(r"DECIMAL\(\d+,\s?\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
        if not found.startswith("STRUCT<"):
            raise ValueError(f"{path} holds no objects")
        schema = found
    wanted = schema if isinstance(schema, str) and schema.upper().startswith("STRUCT<") else ddl(schema)
    return records.select(F.from_json("text", wanted).alias("r")).select("r.*")


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write files that each hold one JSON array of the rows of a partition, a row a line; the path."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([lead + texts[0], *("," + t for t in texts[1:])])], names=["value"])
                lead = ","
        if lead == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    lines.mapInArrow(run, "value string").write.mode(mode).text(path)
    return path
