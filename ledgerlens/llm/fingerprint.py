"""Document fingerprints from prefix polynomial hashes.

The prefix arrays of a text give the hash of every span of SPAN code points; the fingerprint keeps the
hash of the whole text and the SKETCH smallest span hashes. Texts under SHORT code points have spans of
SHORT_SPAN instead, and those from there to twice as long have a sketch of either kind, so that a text and its
edited form, which is a third shorter at most, have a kind in common. The lowest bit of a hash tells its kind.
Sketches are compared in the longest spans both have, and have likeness 0 without a common kind. The likeness of two fingerprints estimates the
share of spans in common (2 J / (1 + J) of the Jaccard estimate J of the sketches). Longest common
extensions of two texts come from the same arrays by binary search.

Defined cases: null text is empty; a text shorter than its span is one span; two empty texts have likeness 1,
an empty and another text 0; documents are ordered by descending id, nulls last, then by text hash, so
repeated ids have a fixed order; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ledgerlens.llm.prefix import PrefixHash, mixed
from ledgerlens.llm.rows import quoted, small_batches
from ledgerlens.session import cut_lineage

SPAN = 16
SHORT_SPAN, SHORT = 4, 64
SKETCH = 64


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Fingerprint:
    """Whole-text hash and sketch of a text, with its prefix arrays while it is in memory."""

    def __init__(self, text: str, span: int = SPAN, sketch: int = SKETCH):
        self.hashes = PrefixHash(points(text))
        self.whole = int(self.hashes.spans(0, self.hashes.n)) if text else 0
        kinds = [span] * (self.hashes.n >= SHORT) + [SHORT_SPAN] * (0 < self.hashes.n < 2 * SHORT)
        found = [self._smallest(min(n, self.hashes.n), int(n != span), sketch) for n in kinds]
        self.sketch = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)
        self.size = sketch

    def _smallest(self, span: int, kind: int, sketch: int) -> np.ndarray:
        order = (mixed(self.hashes.windows(span)) >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | np.uint32(kind)
        if len(order) > 4 * sketch:
            few = np.unique(np.partition(order, 2 * sketch)[: 2 * sketch])
            order = few if len(few) >= sketch else order
        return np.unique(order)[:sketch]

    def __bytes__(self) -> bytes:
        return self.whole.to_bytes(8, "big") + self.sketch.astype(">u4").tobytes()

    def __str__(self) -> str:
        return bytes(self).hex()

    def likeness(self, other: Fingerprint) -> float:
        return likeness(self.sketch, other.sketch, self.size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of spans that two sketches have in common, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    for kind in (0, 1):
        x, y = a[a & 1 == kind], b[b & 1 == kind]
        if len(x) and len(y):
            return _shared(x, y, size)
    return 0.0


def _shared(a: np.ndarray, b: np.ndarray, size: int) -> float:
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    j = float(np.isin(union, both, assume_unique=True).mean())
    return 2 * j / (1 + j)


def sketch_of(fingerprint: str) -> np.ndarray:
    """The sketch in a fingerprint's string."""
    return np.array([int(fingerprint[k : k + 8], 16) for k in range(16, len(fingerprint), 8)], np.uint32)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def compared(text: str, mark: Fingerprint, following: str, next_mark: Fingerprint) -> tuple:
    new = edited(text, following)
    changed = Fingerprint(new)
    digest = hashlib.sha256(new.encode("utf-8", "replace")).digest()
    shared = mark.hashes.extension(0, changed.hashes, 0)
    return len(text), digest, bytes(mark), bytes(changed), mark.likeness(changed), mark.likeness(next_mark), shared


# Hashes are bytes on the way, half as long as their digits in a written table.
_OUT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, shared_start long"
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64())
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _batch(ids: list, id_type: pa.DataType, rows: list[tuple], extra: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    columns = [pa.array(ids, id_type)]
    columns += [pa.array([r[k] if r else None for r in rows], kind) for k, kind in enumerate(_KINDS)]
    return pa.RecordBatch.from_arrays(columns + [a for _, a in extra], names=["doc_id", *_NAMES, *(n for n, _ in extra)])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, with likeness to the edited and the next one.

    Rows are range-partitioned by id, so each task walks its documents in order and needs one neighbour
    beyond them; the first and last document of each task meet in a second, small step.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(docs[quoted(doc_id)].alias("doc_id"), F.coalesce(docs[quoted(text)], F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, kind = TaskContext.get().partitionId(), None, pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, rows, edge = [], [], []
            for i in range(batch.num_rows):
                key, body = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                mark = Fingerprint(body)
                if before is None:
                    ids.append(key), rows.append(None), edge.append((0, body))
                else:
                    ids.append(before[0]), rows.append(compared(before[1], before[2], body, mark)), edge.append((None, None))
                before = (key, body, mark)
            yield _batch(ids, kind, rows, _edge(part, edge))
        if before:
            yield _batch([before[0]], kind, [None], _edge(part, [(1, before[1])]))

    def _edge(part: int, edge: list) -> list:
        return [("part", pa.array([part] * len(edge), pa.int32())), ("edge", pa.array([e for e, _ in edge], pa.int32())),
                ("body", pa.array([b for _, b in edge], pa.string()))]

    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    walked = cut_lineage(ranged.mapInArrow(run, f"doc_id {id_type}, {_OUT}, part int, edge int, body string"), "fingerprints")
    digits = [F.lower(F.hex(f.name)).alias(f.name) if f.dataType == BinaryType() else f.name for f in walked.schema if f.name in _NAMES]
    done = walked.where("edge is null").select("doc_id", *digits)

    # At most one first and one last document for each task.
    places = sorted(r["part"] for r in walked.where("edge = 0").select("part").collect())
    if not places:
        return done
    after = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "part int, next_part int")
    first = walked.where("edge = 0").select(F.col("part").alias("next_part"), F.col("body").alias("following"))
    last = walked.where("edge = 1").select("doc_id", "part", "body").join(after, "part").join(first, "next_part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies, others = (batch.column(i).to_pylist() for i in range(3))
            rows = [compared(a, Fingerprint(a), b, Fingerprint(b)) for a, b in zip(bodies, others, strict=True)]
            yield _batch(keys, batch.schema.field(0).type, rows, [])

    met = last.select("doc_id", "body", "following").mapInArrow(meet, f"doc_id {id_type}, {_OUT}")
    return done.union(met.select("doc_id", *digits))
