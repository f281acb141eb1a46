"""Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups' roots, and proofs.

A row's leaf is the SHA-256 of its fields. Per tree the leaves stand in order; every ARITY consecutive nodes (the
last run may be shorter, even one) give their parent, until one node is left. The roots of the trees, ordered by the
tree's name, are the leaves of one more tree.

Digests travel by time-forward processing: a node sends its digest to its parent's label (tree, level, place), and a
priority queue ordered by label hands a parent all its children's digests when its turn comes. The queue is external:
labels are cut into blocks of ARITY ** LEVELS leaves of one level; messages between blocks are rows that Spark deals by block and
sorts by label, spilling where they don't fit, and messages within a block wait in a heap. A round climbs a block's
levels at once, so the rounds are as many as the logarithm of the largest tree to that base. The sweep then runs
in reverse: the root's empty suffix goes down, each node hands its children the siblings of the level and its own
suffix, and what reaches a leaf is its proof.

Only digests move; texts are hashed where they are read. No task holds more than one block, however large a tree is.

Defined cases: a null field counts as a dash; null trees are one tree, the first; null keys come first; rows that agree in
key and leaf are interchangeable; an empty table gives no rows; a tree of one leaf is that leaf; very long texts are
hashed whole by Spark's own function; columns whose names clash with new ones give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ledgerlens.llm.rows import others, quoted
from ledgerlens.plans.groups import null_safe_join
from ledgerlens.plans.ordered import SLICE, sliced
from ledgerlens.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
LEVELS = 7
DIGITS = 64


def record_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields: each is a dash if null, else its number of bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined_digest(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climbed(size: int, turn: int, most: int) -> int:
    """How many levels, at most `most`, a block of that round climbs in a tree of so many leaves."""
    nodes = -(-size // ARITY ** (most * turn))
    if nodes > ARITY**most:
        return most
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def sweep(leaves: list[str], levels: int) -> list[list[str]]:
    """Digests of a block's nodes, a list for each level; nodes are made in the order of their labels."""
    nodes: list[list[str]] = [leaves, *([] for _ in range(levels))]
    queue = [(1, i // ARITY, i, d) for i, d in enumerate(leaves)] if levels else []  # in order, so a heap
    while queue:
        label, children = queue[0][:2], []
        while queue and queue[0][:2] == label:
            children.append(heappop(queue)[3])
        level, place = label
        digest = joined_digest(children)
        nodes[level].append(digest)
        if level < levels:
            heappush(queue, (level + 1, place // ARITY, place, digest))
    return nodes


def delivered(nodes: list[list[str]], suffix: str) -> list[str]:
    """The proof of each leaf of a block whose top node's proof is suffix.

    A proof is text: for each level the place in the run and the siblings' digests, levels parted by commas.
    """
    above = [suffix]
    for row in reversed(nodes[:-1]):
        here = []
        for i in range(len(row)):
            at = i % ARITY
            run = row[i - at : i - at + ARITY]
            step = str(at) + "".join(run[:at] + run[at + 1 :])
            up = above[i // ARITY]
            here.append(f"{step},{up}" if up else step)
        above = here
    return above


def steps(proof: str) -> list[tuple[int, list[str]]]:
    """(place, siblings) of each level of a proof."""
    return [(int(s[0]), [s[k : k + DIGITS] for k in range(1, len(s), DIGITS)]) for s in proof.split(",")] if proof else []


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its siblings make."""
    for step in proof.split(",") if proof else ():
        cut = 1 + DIGITS * int(step[0])
        leaf = hashlib.sha256(f"{step[1:cut]}{leaf}{step[cut:]}".encode()).hexdigest()
    return leaf


def proof_digest(proof: str) -> str:
    return joined_digest([s[1:] for s in proof.split(",")])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that end with a block; rows come sorted by (tree, block)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        trees, blocks = table.column("tree"), table.column("block")
        last, cut = (trees[-1].as_py(), blocks[-1].as_py()), table.num_rows
        while cut and (trees[cut - 1].as_py(), blocks[cut - 1].as_py()) == last:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table) -> Iterator[tuple[int, int]]:
    trees, blocks = table.column("tree").to_pylist(), table.column("block").to_pylist()
    start = 0
    for i in range(1, len(blocks) + 1):
        if i == len(blocks) or blocks[i] != blocks[start] or trees[i] != trees[start]:
            yield start, i
            start = i


def _swept(rows: DataFrame, fn: Callable[[pa.Table], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """fn over whole blocks, each with its rows in the order of their labels."""
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            yield fn(table)

    return dealt.mapInArrow(run, schema)


def _blocked(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**most).cast("long"))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with pos, the place in the tree, and size, the number of the tree's leaves; written.

    Rows are sorted in ranges; one row for each tree and range carries the counts over.
    """
    parts = sliced(rows, ["tree"], list(order))
    whole = Window.partitionBy("tree")
    counts = parts.groupBy("tree", SLICE).agg(F.count(F.lit(1)).alias("n")).select(
        "tree", SLICE, (F.sum("n").over(whole.orderBy(SLICE)) - F.col("n")).alias("start"), F.sum("n").over(whole).alias("size"))
    local = F.row_number().over(Window.partitionBy("tree", SLICE).orderBy(*order)) - 1
    placed = null_safe_join(parts.withColumn("at", local.cast("long")), counts, ["tree", SLICE])
    return cut_lineage(placed.select(*rows.columns, (F.col("start") + F.col("at")).alias("pos"), "size"), "merkle-leaves")


def climb(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Nodes (tree, pos, size, digest) by round: the leaves, the block tops, their block tops, and at last the roots."""
    rounds = [leaves.select("tree", "pos", "size", "digest")]
    while True:
        turn = len(rounds) - 1

        def up(table: pa.Table, turn: int = turn) -> pa.RecordBatch:
            trees, blocks = table.column("tree").to_pylist(), table.column("block").to_pylist()
            sizes, digests = table.column("size").to_pylist(), table.column("digest").to_pylist()
            out = [(trees[a], blocks[a], sizes[a], sweep(digests[a:b], climbed(sizes[a], turn, most))[-1][0]) for a, b in _runs(table)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "size", "digest"])

        tops = _swept(_blocked(rounds[-1], most), up, "tree string, pos long, size long, digest string")
        rounds.append(cut_lineage(tops, "merkle-nodes"))
        if (rounds[-1].agg(F.max("pos")).first()[0] or 0) == 0:  # every tree has one node left
            return rounds


def _sent(nodes: DataFrame, suffixes: DataFrame, most: int) -> DataFrame:
    """Nodes, and before each block's nodes the suffix that its top node sends down."""
    tops = suffixes.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "size", "suffix", "top")
    return _blocked(nodes, most).unionByName(tops, allowMissingColumns=True)


def _opened(table: pa.Table, turn: int, most: int) -> Iterator[tuple[int, int, str, list[str]]]:
    """Place of the first node of each block, place behind the last one, digest of the tree's root, proofs."""
    sizes, digests = table.column("size").to_pylist(), table.column("digest").to_pylist()
    suffixes, tops = table.column("suffix").to_pylist(), table.column("top").to_pylist()
    for a, b in _runs(table):
        yield a + 1, b, tops[a], delivered(sweep(digests[a + 1 : b], climbed(sizes[a], turn, most)), suffixes[a])


def descend(rounds: list[DataFrame], suffixes: DataFrame, most: int) -> DataFrame:
    """Suffixes (tree, pos, size, suffix, top) of the first block tops from those of the roots."""
    for turn in range(len(rounds) - 2, 0, -1):

        def down(table: pa.Table, turn: int = turn) -> pa.RecordBatch:
            at, proofs, tops = [], [], []
            for a, b, top, found in _opened(table, turn, most):
                at += range(a, b)
                proofs += found
                tops += [top] * (b - a)
            kept = table.select(["tree", "pos", "size"]).take(pa.array(at, pa.int64())).combine_chunks()
            columns = [c.combine_chunks() for c in kept.columns] + [pa.array(proofs, pa.string()), pa.array(tops, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "size", "suffix", "top"])

        suffixes = _swept(_sent(rounds[turn], suffixes, most), down, "tree string, pos long, size long, suffix string, top string")
    return suffixes


def _proved(leaves: DataFrame, suffixes: DataFrame, kept: Sequence[str], most: int) -> DataFrame:
    """kept columns of the leaves, with proof (text), top and folded, the root made of the column received."""
    fields = [leaves.schema[c] for c in kept]
    fields = [StructField(f.name, f.dataType) for f in fields]
    schema = StructType([*fields, *_parse_datatype_string("proof string, top string, folded string").fields])

    def prove(table: pa.Table) -> pa.RecordBatch:
        received = table.column("received").to_pylist()
        at, proofs, tops = [], [], []
        for a, b, top, found in _opened(table, 0, most):
            at += range(a, b)
            proofs += found
            tops += [top] * (b - a)
        own = table.select(list(kept)).take(pa.array(at, pa.int64()))
        folded = [fold(received[i], p) for i, p in zip(at, proofs, strict=True)]
        columns = [c.combine_chunks() for c in own.columns] + [pa.array(x, pa.string()) for x in (proofs, tops, folded)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _swept(_sent(leaves, suffixes, most), prove, schema)


def _forest(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Rounds of the trees, the roots as ranked leaves of the tree above them (name, pos, ...), rounds of that tree."""
    rounds = climb(leaves, most)
    roots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("size").alias("leaves"), "digest")
    tops = ranked(roots, ["name"])
    return rounds, tops, climb(tops, most)


def _leaves(docs: DataFrame, fields: Sequence[str], tree: str, order: str, received: dict[str, Column], carry: Sequence[str]) -> DataFrame:
    """Columns c0, c1, ... of the carried ones, tree, key, digest and received (the leaf of the rows as received)."""
    digest = record_digest([docs[quoted(c)] for c in fields])
    arrived = record_digest([received.get(c, docs[quoted(c)]) for c in fields]) if received else digest
    named = [docs[quoted(c)].alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(*named, docs[quoted(tree)].cast("string").alias("tree"), docs[quoted(order)].alias("key"), digest.alias("digest"), arrived.alias("received"))
    return ranked(rows, ["key", "digest"])


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "source", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """One row a tree: tree, leaves, subroot, root."""
    _, tops, above = _forest(_leaves(docs, fields, tree, order, {}, []), levels)
    return tops.select(F.col("name").alias("tree"), "leaves", F.col("digest").alias("subroot"), above[-1].select("digest").scalar().alias("root"))


def audit(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    tree: str = "source",
    order: str = "doc_id",
    received: dict[str, Column] | None = None,
    carry: Sequence[str] | None = None,
    with_proof: bool = False,
    levels: int = LEVELS,
) -> DataFrame:
    """Columns of docs with leaf, subroot, root, proof_sha256, folded_root and verified for each row.

    received gives fields as they arrived, by expressions over docs; folded_root is made of them and of the
    original siblings, and verified tells whether it is the root. with_proof adds proof, the steps from the leaf
    to the root, each with the place in its run and the siblings. carry names the columns to keep, all by default. levels: how many a block climbs in a round.
    """
    new = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proof
    kept = [c for c in others(docs, new) if carry is None or c in carry]
    names = [f"c{i}" for i in range(len(kept))]
    leaves = _leaves(docs, fields, tree, order, received or {}, kept)
    rounds, tops, above = _forest(leaves, levels)
    # The tree above sends each root its proof; the trees send them on to the leaves.
    start = above[-1].select("tree", "pos", "size", F.lit("").alias("suffix"), F.col("digest").alias("top"))
    roots = _proved(tops.withColumn("received", F.col("digest")), descend(above, start, levels), ["name", "leaves", "digest"], levels)
    start = roots.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("leaves").alias("size"), F.col("proof").alias("suffix"), F.col("digest").alias("top"))
    found = _proved(leaves, descend(rounds, start, levels), [*names, "digest"], levels)
    root = above[-1].select("digest").scalar()
    siblings = F.regexp_replace("proof", "(^|,)[0-9]", "")
    out = found.select(
        *names, F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"),
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        *[_steps(F.col("proof")).alias("proof")] * with_proof,
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
    order_of = [*names, *new]
    return out.select(*order_of).toDF(*kept, *new)


def _steps(proof: Column) -> Column:
    """The text of a proof as steps of place and siblings."""
    return F.transform(
        F.filter(F.split(proof, ","), lambda s: s != ""),
        lambda s: F.struct(
            F.substring(s, 1, 1).cast("int").alias("place"),
            F.regexp_extract_all(F.substring(s, 2, ARITY * DIGITS), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0)).alias("siblings"),
        ),
    )
