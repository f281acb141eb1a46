"""Remove repeated long substrings: suffix sorting one bucket at a time with a difference cover.

A string of `size` bytes that starts at i and elsewhere at j is found through the sample positions of a
perfect difference cover modulo PERIOD: for any i and j some offset below PERIOD takes both to sample
positions, so it is enough to sort the sample suffixes. They are dealt by a hash of their first
size - PERIOD + 1 bytes into buckets, and each task sorts one bucket at a time; suffixes that tie there may
begin a repeat. Ties are resolved by the rank of the whole neighbourhood of a sample, all bytes that strings
found through it can reach: where two neighbourhoods are equal, all strings of the sample repeat. Only for
samples whose neighbourhood is alone in its tie the strings around it are hashed and sorted in the same way,
together with one neighbourhood of each equal class of that tie, so every string meets its copies.

Equality is equality of 62-bit polynomial hashes (two primes), by which distinct strings agree with
probability of about 2^-62 for each pair.

A bucket holds one record for equal ones of a task's chunk, so a passage that a third of all rows share is
a few records. Defined cases: null text is empty; texts shorter than `size` keep everything; matches do not
cross documents; repeated rows are copies of each other and lose everything that is long enough; very long
texts are worked through in pieces that overlap by a neighbourhood.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.prefix import PrefixHash, mixed
from ledgerlens.llm.rows import quoted, small_batches
from ledgerlens.session import cut_lineage

SIZE = 400
PERIOD = 273
PIECE = 1 << 22
CHUNK = 1 << 22


def difference_cover(period: int = PERIOD, seeds: tuple[int, ...] = (1, 91, 117)) -> np.ndarray:
    """The perfect difference cover modulo 273: 1, 91 and 117 closed under doubling."""
    cover = set(seeds)
    while more := {2 * x % period for x in cover} - cover:
        cover |= more
    return np.array(sorted(cover))


COVER = difference_cover()
_BACK = PERIOD - 1  # bytes before a sample that its strings may start at
_MULTI = np.uint32(1 << 31)
FULL, SHOWN, OPEN, START = 0, 1, 2, 3
_MARKS = "slice int, docs binary, counts binary, places binary"
_CELL = "bucket int, a binary, b binary, doc binary, place binary, known binary"


def _pieces(n: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches [first, last) of positions with the bytes [low, high) that their hashes need."""
    for first in range(0, n, PIECE):
        last = min(n, first + PIECE)
        yield first, last, max(0, first - _BACK), min(n, last + size)


def _samples(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the head, rank of the neighbourhood, and place of each sample position of a document."""
    n, head, found = len(raw), size - PERIOD + 1, []
    for first, last, low, high in _pieces(n, size):
        hashes = PrefixHash(raw[low:high])
        turns = np.arange(first // PERIOD, last // PERIOD + 1)
        p = (turns[:, None] * PERIOD + COVER[None, :]).ravel()
        p = p[(p >= first) & (p < last) & (p + head <= n)]
        left, right = np.maximum(0, p - _BACK), np.minimum(n, p + size)
        around = hashes.spans(left - low, right - low)
        lengths = ((p - left) << 32 | (right - p)).astype(np.uint64)
        found.append((hashes.spans(p - low, p + head - low), mixed(around ^ mixed(lengths)), p))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cells(a: np.ndarray, b: np.ndarray | None, doc: np.ndarray, place: np.ndarray, buckets: int, asked: np.ndarray | None) -> pa.RecordBatch:
    """Records of a chunk, one for equal ones, dealt into buckets; what is already known to repeat rides along.

    place carries in its highest bit that the record stands for several. asked: which records want an answer.
    """
    order = np.lexsort((a,) if b is None else (b, a))
    same = a[order][1:] == a[order][:-1]
    if b is not None:
        same &= b[order][1:] == b[order][:-1]
    first = np.concatenate([[True], ~same]) if len(order) else np.empty(0, bool)
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1 if len(order) else first
    want = np.ones(len(order), bool) if asked is None else asked[order]
    told = many & want
    known_doc, known_place = doc[order][told], place[order][told]
    keep = first
    # A record that stands for several has been answered; one that stands for itself is asked in its bucket.
    flag = np.where(many, _MULTI, np.uint32(0)) | (np.where(want & ~many, np.uint32(1 << 30), np.uint32(0)))
    a2, doc2 = a[order][keep], doc[order][keep]
    place2 = place[order][keep].astype(np.uint32) | flag[keep]
    b2 = None if b is None else b[order][keep]
    # The heads decide the bucket; mixing evens them out.
    bucket = (mixed(a2) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    known_edges = np.linspace(0, len(known_doc), buckets + 1).astype(np.int64)
    rows = []
    for k in range(buckets):
        part = by[edges[k] : edges[k + 1]]
        part = part[np.argsort(doc2[part], kind="stable")]
        ka, kb = known_edges[k], known_edges[k + 1]
        if len(part) or kb > ka:
            known = known_doc[ka:kb].tobytes() + known_place[ka:kb].astype(np.uint32).tobytes()
            rows.append((k, a2[part].tobytes(), b"" if b2 is None else b2[part].tobytes(), doc2[part].tobytes(), place2[part].tobytes(), known))
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _CELL.split(", ")])


def _bucket(table: pa.Table) -> tuple[np.ndarray, ...]:
    """All records of one bucket: a, b, doc, place, stands for several, asked, and the known (doc, place)."""
    place = _joined(table, "place", np.uint32)
    known = [x.as_py() for x in table.column("known")]
    sizes = [len(x) // 12 for x in known]
    known_doc = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x[: 8 * n], np.int64) for x, n in zip(known, sizes, strict=True))])
    known_place = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(x[8 * n :], np.uint32) for x, n in zip(known, sizes, strict=True))])
    return (_joined(table, "a", np.uint64), _joined(table, "b", np.uint64), _joined(table, "doc", np.int64), place & np.uint32((1 << 30) - 1),
            (place & _MULTI) != 0, (place >> np.uint32(30) & np.uint32(1)) != 0, known_doc, known_place)


def _by_slice(doc: np.ndarray, place: np.ndarray, kind: np.ndarray, slices: int) -> pa.Table:
    """Places with their kinds in the two highest bits, packed by document, one row for each slice of documents."""
    part = (mixed(doc.view(np.uint64)) % np.uint64(slices)).astype(np.int64)
    order = np.lexsort((doc, part))
    doc, part, place = doc[order], part[order], (place.astype(np.uint32) | kind.astype(np.uint32) << np.uint32(30))[order]
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([edge, [len(doc)]])).astype(np.uint32)
    docs, edges = doc[edge], np.searchsorted(part, np.arange(slices + 1))
    doc_edges = np.searchsorted(part[edge], np.arange(slices + 1))
    rows = []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        of = slice(doc_edges[k], doc_edges[k + 1])
        rows.append((k, docs[of].tobytes(), counts[of].tobytes(), place[edges[k] : edges[k + 1]].tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["slice", "docs", "counts", "places"])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_py(), kind) for x in table.column(name))])


def gather(table: pa.Table) -> pa.Table:
    """One row for each document of a slice, with all its places."""
    docs, counts, places = _joined(table, "docs", np.int64), _joined(table, "counts", np.uint32), _joined(table, "places", np.uint32)
    each = np.repeat(docs, counts)
    order = np.argsort(each, kind="stable")
    each, raw = each[order], places[order].tobytes()
    edge = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.empty(0, np.int64)
    stops = np.concatenate([edge[1:], [len(each)]]) if len(each) else edge
    own = [raw[4 * a : 4 * b] for a, b in zip(edge.tolist(), stops.tolist(), strict=True)]
    return pa.table({"doc": pa.array(each[edge], pa.int64()), "places": pa.array(own, pa.binary())})


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Number of the group of equal keys, for records in sorted order."""
    change = np.zeros(len(order), bool)
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return np.cumsum(change)


def sort_samples(table: pa.Table, slices: int) -> pa.Table:
    """Sort the sample suffixes of one bucket; the samples that may begin repeats, by document."""
    a, b, doc, place, many, _, known_doc, known_place = _bucket(table)
    order = np.lexsort((place, doc, b, a))
    head, whole = _groups(order, a), _groups(order, a, b)
    many, doc, place = many[order], doc[order], place[order]
    n_head = np.bincount(head, weights=1 + many) if len(head) else np.empty(0)
    n_whole = np.bincount(whole, weights=1 + many) if len(whole) else np.empty(0)
    tied, full = n_head[head] > 1, n_whole[whole] > 1
    alone = tied & ~full
    active = np.bincount(head, weights=alone) > 0 if len(head) else np.empty(0, bool)
    first = np.concatenate([[True], whole[1:] != whole[:-1]]) if len(whole) else np.empty(0, bool)
    kind = np.where(alone, OPEN, np.where(first & active[head] if len(head) else first, SHOWN, FULL))
    kept = full | alone
    kinds = np.concatenate([kind[kept], np.full(len(known_doc), FULL)])
    return _by_slice(np.concatenate([doc[kept], known_doc]), np.concatenate([place[kept], known_place]), kinds, slices)


def sort_strings(table: pa.Table, slices: int) -> pa.Table:
    """Sort the strings of one bucket; the asked ones that occur again, by document."""
    a, _, doc, place, many, asked, known_doc, known_place = _bucket(table)
    order = np.argsort(a, kind="stable")
    group = _groups(order, a)
    n = np.bincount(group, weights=1 + many[order]) if len(group) else np.empty(0)
    kept = order[(n[group] > 1) & asked[order]] if len(group) else order
    doc, place = np.concatenate([doc[kept], known_doc]), np.concatenate([place[kept], known_place])
    return _by_slice(doc, place, np.full(len(doc), START), slices)


def _ranges(p: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which string starts 0 to n - size belong to the samples p."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(0, p - _BACK), 1)
    np.add.at(mark, np.minimum(p, n - size) + 1, -1)
    return np.cumsum(mark[: n - size + 1]) > 0


def _split(places: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(places or b"", np.uint32)
    return (both & np.uint32((1 << 30) - 1)).astype(np.int64), both >> np.uint32(30)


def _open_strings(raw: np.ndarray, places: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and whether an answer is wanted, of the strings of open and shown samples of a document."""
    p, kind = _split(places)
    n = len(raw)
    settled, asked = _ranges(p[kind != OPEN], n, size), _ranges(p[kind == OPEN], n, size)
    starts = np.flatnonzero(asked | _ranges(p[kind == SHOWN], n, size))
    hashes = []
    for first, last, low, high in _pieces(n, size):
        some = starts[(starts >= first) & (starts < last)]
        if len(some):
            hashes.append(PrefixHash(raw[low:high]).spans(some - low, some + size - low))
    return np.concatenate([np.empty(0, np.uint64), *hashes]), starts, (asked & ~settled)[starts]


def _dealt(batches: Iterator[pa.RecordBatch], records, buckets: int, answer: bool) -> Iterator[pa.RecordBatch]:
    """Cells of chunks of documents; records gives (a, b, place, asked) of one row."""
    held: list[tuple] = []
    chars = 0
    for batch in batches:
        for i in range(batch.num_rows):
            doc, body = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            raw = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
            found = records(raw, batch, i)
            if found is not None and len(found[0]):
                held.append((*found, np.full(len(found[0]), doc, np.int64)))
            chars += len(raw)
            if chars >= CHUNK and held:
                yield _chunk(held, buckets, answer)
                held, chars = [], 0
    if held:
        yield _chunk(held, buckets, answer)


def _chunk(held: list[tuple], buckets: int, answer: bool) -> pa.RecordBatch:
    a, b, place, asked, doc = (None if x[0] is None else np.concatenate(x) for x in zip(*held, strict=True))
    return _cells(a, b, doc, place, buckets, asked if answer else None)


def repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc, places, one row for each of docs (doc, text) that has any: samples whose strings all repeat (kinds
    FULL and SHOWN), starts of repeated strings (START), and open samples, which only told where to look."""
    if size < PERIOD + 16:
        raise ValueError(f"size must be at least {PERIOD + 16}")
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long_enough = docs.where(F.octet_length("text") >= size)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(raw, batch, i):
            a, b, p = _samples(raw, size)
            return a, b, p, None

        return _dealt(batches, one, buckets, False)

    cells = long_enough.select("doc", "text").mapInArrow(samples, _CELL)
    found = cells.groupBy("bucket").applyInArrow(lambda table: sort_samples(table, buckets), _MARKS)
    found = cut_lineage(found, "samples")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(raw, batch, i):
            h, p, asked = _open_strings(raw, batch.column(2)[i].as_py(), size)
            return h, None, p, asked

        return _dealt(batches, one, buckets, True)

    marks = found.groupBy("slice").applyInArrow(gather, "doc long, places binary")
    around = long_enough.select("doc", "text").join(marks, "doc").mapInArrow(strings, _CELL)
    ends = around.groupBy("bucket").applyInArrow(lambda table: sort_strings(table, buckets), _MARKS)
    return found.union(cut_lineage(ends, "strings")).groupBy("slice").applyInArrow(gather, "doc long, places binary")


def removed_mask(n: int, places: bytes | None, size: int = SIZE) -> np.ndarray:
    """Which bytes of a document of n bytes are covered by repeated strings."""
    p, kind = _split(places)
    if n < size or not len(p):
        return np.zeros(n, bool)
    starts = _ranges(p[kind <= SHOWN], n, size)
    starts[p[kind == START]] = True
    edge = np.diff(np.concatenate([[0], starts.view(np.int8), [0]]))
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.flatnonzero(edge == 1), 1)
    np.add.at(mark, np.flatnonzero(edge == -1) - 1 + size, -1)
    return np.cumsum(mark[:n]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) and spans."""
    body = F.coalesce(docs[quoted(text)], F.lit(""))
    slim = docs.select(docs[quoted(doc_id)].alias("doc_id"), body.alias("text"))
    slim = slim.withColumn("doc", F.xxhash64("doc_id", "text"))
    marks = repeated(slim, size)
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, spans array<struct<start:long,stop:long>>" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode("utf-8", "replace")
                gone = removed_mask(len(raw), batch.column(2)[i].as_py(), size)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
                edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in runs]))
            kinds = [pa.int64()] * 3 + [pa.string()]
            if with_text:
                kinds += [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in schema.replace("start:long,stop:long", "").split(", ")]
            )

    return slim.join(marks, "doc", "left").select("doc_id", "text", "places").mapInArrow(run, schema)
