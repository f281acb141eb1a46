"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 64 bits, eight bytes. If two fingerprints differ in at most `distance` bits, at least
8 - distance bytes agree in their place. The inverted index files a fingerprint under several positional
bytes read together (every choice of KEY_BYTES of the first 8 - least + KEY_BYTES positions, so that a pair with
the guaranteed number of equal bytes meets in some list); one positional byte alone has 256 values and its lists
would grow with the square of the table. Within a list all equal positional bytes of a pair are tallied, pairs
below the guaranteed minimum go, and the rest are verified bit by bit. A list of more than LONG_LIST fingerprints
is split by a further byte, up to the guaranteed number: its members are filed anew under each other position.
Each list gives a spanning forest of its links, never all pairs, so n fingerprints give fewer than n rows.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows are linked to each other; a null doc_id never names
a component unless all of its ids are null; an empty table has no classes; a text of any length is hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import components
from ledgerlens.llm.rows import quoted, with_text_columns
from ledgerlens.session import cut_lineage

SHINGLE = 4
SEED = 42
DISTANCE = 4
KEY_BYTES = 3
#: Fingerprints of a list that are compared in one task; longer lists are split.
LONG_LIST = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """Columns of docs with simhash, the fingerprint as a signed long."""

    def run(texts: pa.Array) -> list:
        bits = np.array([fingerprint(x.as_py(), shingle) for x in texts], np.uint64)
        return [pa.array(bits.view(np.int64))]

    return with_text_columns(docs, text, "simhash long", run, carry)


def enough_matches(differences: np.ndarray, distance: int) -> np.ndarray:
    """The count filter: whether as many positional bytes agree as a pair within the distance must share."""
    return (differences.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - distance


def _near(differences: np.ndarray, distance: int) -> np.ndarray:
    near = enough_matches(differences, distance)
    near[near] = np.bitwise_count(differences[near]) <= distance
    return near


def _list_links(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one list of distinct fingerprints."""
    links, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = _near(rest ^ node, distance)
            if near.any():
                links += [(int(node), int(v)) for v in rest[near]]
                queue.extend(rest[near])
                rest = rest[~near]
    return links


def _byte(position: int) -> int:
    """The mask of one positional byte as a signed long."""
    mask = 0xFF << (8 * position)
    return mask - (1 << 64) if mask >> 63 else mask


def _filed(members: DataFrame, masks: list[Column]) -> DataFrame:
    """mask, key, fp: every fingerprint under each of the masks that is not null."""
    each = members.select("fp", F.explode(F.array_compact(F.array(*masks))).alias("mask"))
    return each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(prints: DataFrame, distance: int = DISTANCE, key_bytes: int = KEY_BYTES, long_list: int = LONG_LIST) -> DataFrame:
    """Links a, b between the distinct longs of column fp that connect all pairs within the distance.

    key_bytes is at most 8 - distance. Only the connected classes are kept whole, not every single pair.
    Lists of exactly 8 - distance bytes are not split further; they hold different fingerprints that agree in these.
    """
    least = 8 - distance
    if not 1 <= key_bytes <= least:
        raise ValueError("key_bytes must lie between 1 and the guaranteed number of equal bytes")
    choices = combinations(range(8 - least + key_bytes), key_bytes)
    index = _filed(prints, [F.lit(sum(map(_byte, c))) for c in choices])
    short = []
    for _ in range(key_bytes, least):
        sizes = index.groupBy("mask", "key").agg(F.count("*").alias("n"))
        long = cut_lineage(sizes.where(F.col("n") > long_list).select("mask", "key"), "simhash-long")
        if long.isEmpty():
            break
        short.append(index.join(long, ["mask", "key"], "left_anti"))
        wider = [F.col("mask").bitwiseOR(F.lit(_byte(p))) for p in range(8)]
        wider = [F.when(w != F.col("mask"), w) for w in wider]
        index = _filed(index.join(long, ["mask", "key"], "left_semi"), wider).distinct()
    index = reduce(DataFrame.unionByName, [*short, index])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last list, as far as it was read
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            if not len(rows):
                continue
            before = held[-1][-1:] if held else rows[:1]
            edge = np.flatnonzero((np.diff(rows[:, :2], axis=0, prepend=before[:, :2]) != 0).any(axis=1))
            if len(edge):
                done = np.concatenate([*held, rows[: edge[-1]]])
                yield _linked(done, edge[:-1] + len(done) - edge[-1], distance)
                held = []
            held.append(rows[edge[-1] :] if len(edge) else rows)
        if held:
            yield _linked(np.concatenate(held), np.empty(0, np.int64), distance)

    lists = index.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return lists.mapInArrow(run, "a long, b long").distinct()


def _linked(rows: np.ndarray, edge: np.ndarray, distance: int) -> pa.RecordBatch:
    """The links of lists that lie one after another, cut at edge."""
    a, b = [], []
    if len(rows):
        fps, starts = np.ascontiguousarray(rows[:, 2]).view(np.uint64), np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        pairs = starts[sizes == 2]  # by far the most lists, checked together
        near = pairs[_near(fps[pairs] ^ fps[pairs + 1], distance)]
        a, b = fps[near].tolist(), fps[near + 1].tolist()
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for u, v in _list_links(fps[start : start + size], distance):
                a.append(u)
                b.append(v)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"]
    )


def _classes(marked: DataFrame, distance: int, key_bytes: int) -> DataFrame:
    """fp, component, component_id of all fingerprints in marked (doc_id, simhash)."""
    prints = marked.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("first"))
    roots = components(cut_lineage(links(prints, distance, key_bytes), "simhash-links"))
    classes = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("component")
    )
    names = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    return classes.join(names, "component").select("fp", "component", "component_id")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    key_bytes: int = KEY_BYTES,
) -> DataFrame:
    """doc_id, simhash, component_id (the smallest doc_id reachable) and component, one row per document.

    component is the class itself, which tells classes apart even where ids repeat.
    """
    slim = docs.select(docs[quoted(doc_id)].alias("doc_id"), docs[quoted(text)].alias("text"))
    marked = cut_lineage(fingerprints(slim, "text", shingle, ["doc_id"]), "simhash")
    classes = _classes(marked, distance, key_bytes)
    return marked.join(classes, F.col("simhash") == F.col("fp")).select("doc_id", "simhash", "component_id", "component")


def first_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    key_bytes: int = KEY_BYTES,
) -> DataFrame:
    """One row of docs from each near-duplicate class: the one with the smallest doc_id, null ids last.

    Rows are numbered in a written table, so of rows that agree in everything one stays too.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    whole = fingerprints(docs.toDF(*names), at[text], shingle)
    whole = cut_lineage(whole.withColumn("row", F.monotonically_increasing_id()), "simhash-documents")
    ids = whole.select(F.col(at[doc_id]).alias("doc_id"), "simhash", "row")
    classes = _classes(ids, distance, key_bytes)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = ids.join(classes, F.col("simhash") == F.col("fp")).groupBy("component").agg(F.min(order).alias("first"))
    return whole.join(stays.select("first.row"), "row", "left_semi").select(*names).toDF(*docs.columns)
