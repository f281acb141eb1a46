"""Run a function over the texts of Arrow batches and append what it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


#: Rows of one Arrow batch; texts are long, and a batch stands in the memory of both sides.
BATCH_ROWS = 2500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to a size that suits texts; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, rows)


def others(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of df whose names do not clash, in any case, with the names an operator adds."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_text_columns(
    df: DataFrame,
    text: str,
    added: str,
    fn: Callable[[pa.Array], list],
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Columns of df and the columns that fn makes of the text column, batch by batch.

    added is the DDL of the new columns. carry names the columns of df to keep, all by default; a column
    whose name clashes with a new one gives way to it.
    """
    small_batches(df.sparkSession)
    new = _parse_datatype_string(added)
    kept = [c for c in others(df, new.names) if carry is None or c in carry]
    place = kept.index(text) if text in kept else None
    columns = [df[quoted(c)].alias(f"c{i}") for i, c in enumerate(kept)]
    if place is None:
        columns.append(df[quoted(text)].alias("text"))
    fields = [StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
    fields += [StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields)]
    names = [f.name for f in fields]
    at, width = (len(kept) if place is None else place), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(i) for i in range(width)] + fn(batch.column(at))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select(*columns).mapInArrow(run, StructType(fields)).toDF(*kept, *new.names)
