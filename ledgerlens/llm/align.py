"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A encodes a blank and the text, tokenizer B the text (it adds the blank itself). Both cut the same bytes, so
their tokens are two sorted lists of end offsets. Offsets where both end cut the tokens into groups; every A and B token of a
group are linked. How many documents link a pair of ids tells a good partner from a chance one.

The two lists of ends are merged by merge paths: the tokens of many documents stand on end, diagonals PIECE ends apart are searched by bisection for the place
where the merge crosses them, and the pieces between diagonals, equal in work and independent, are merged side by side. Each
piece emits its overlaps (an A and a B token that share bytes) and closes a group where both tokens end; groups that run across a diagonal are stitched
by a running count of the closed groups over the pieces.

Documents are worked on in blocks of BLOCK_CHARS characters. A block writes its documents' links as numbers of the block's distinct
pairs, and the distinct pairs with their number of documents. Spark sums these over the corpus and sends each block the counts of its pairs, so
what is shuffled is a row for each block and pair, not for each document and pair.

Defined cases: a text that is null or empty, or that one of the tokenizers does not give back byte for byte, has no tokens and all zeros;
repeated rows count as documents of their own; an empty table gives no rows; a document longer than a block is a block of its own,
so the longest text, and the distinct ids of its largest group, bound a task's memory; columns whose names clash with new ones give way.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from sentencepiece import SentencePieceProcessor

from ledgerlens.llm.rows import others, quoted, small_batches
from ledgerlens.llm.tokens import load_tokenizer
from ledgerlens.session import cut_lineage

BLOCK_CHARS = 1 << 20
#: Ends of one merged piece.
PIECE = 256
#: Words kept with their ids in a task and the longest one kept; words encoded in one line, and lines encoded at once.
KEPT_WORDS, KEPT_CHARS = 400_000, 64
JOINED, TEXTS = 256, 64
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Links of one group that are written out one by one; larger groups are counted by distinct ids.
GROUP_LINKS = 1 << 12
#: Bits of an id; a pair and a document's number in its block are one number of 63 bits.
_SHIFT = 20


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level vocabularies and their bytes: visible Latin-1 stands for itself, the rest from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(0x100) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """One tokenizer, with the bytes of each id."""

    def __init__(self, token_bytes: list[bytes]):
        if len(token_bytes) > 1 << _SHIFT:
            raise ValueError(f"more than {1 << _SHIFT} ids")
        self.token_bytes = token_bytes
        self.sizes = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class ByteLevel(Vocabulary):
    def __init__(self, file: str):
        self.tokenizer = load_tokenizer(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        alphabet = byte_alphabet()
        found = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            found[i] = bytes(alphabet[c] for c in token) if set(token) <= alphabet.keys() else token.encode()
        super().__init__(found)

    def encode(self, lines: list[str]) -> list[list[int]]:
        """Ids of lines, each of which starts with a blank."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]


class Pieces(Vocabulary):
    def __init__(self, file: str):
        self.processor = sp = SentencePieceProcessor(model_file=file)
        found = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in found):
            raise ValueError("a piece of the model goes on behind a blank")
        super().__init__([bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(found)])

    def encode(self, lines: list[str]) -> list[list[int]]:
        return [self.processor.encode(line[1:]) for line in lines]  # it adds the blank


class Words:
    """Ids of both tokenizers; each different word with its blank is encoded once for as long as it is kept.

    Lines are cut at single blanks between two characters that are not white space. There byte-level pre-tokenisation starts a
    new piece, and no piece of the other model goes on behind a blank, so neither tokenizer joins what the cut parts.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides = (a, b)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.sizes = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.bad = np.empty(0, bool)

    def add(self, found: list[tuple[list[str], list[np.ndarray], list[np.ndarray], np.ndarray]]) -> None:
        """Keep (words, ids of each side on end, numbers of ids, whether the bytes differ)."""
        words = [w for x in found for w in x[0]]
        self.place.update(zip(words, range(len(self.bad), len(self.bad) + len(words)), strict=True))
        for side in (0, 1):
            self.ids[side] = np.concatenate([self.ids[side], *(x[1][side] for x in found)])
            self.sizes[side] = np.concatenate([self.sizes[side], *(x[2][side] for x in found)])
        self.bad = np.concatenate([self.bad, *(x[3] for x in found)])

    def learn(self, words: list[str]) -> None:
        """Encode new words, many in one line; the ids' bytes tell where a word ends."""
        alone = [w for w in words if not w or w != w.strip()]
        rest = [w for w in words if w and w == w.strip()]
        groups = [rest[k : k + JOINED] for k in range(0, len(rest), JOINED)]
        learned = []
        for k in range(0, len(groups), TEXTS):
            some = groups[k : k + TEXTS]
            lines = ["".join([" " + w for w in g]) for g in some]
            for own, line, *found in zip(some, lines, *(v.encode(lines) for v in self.sides), strict=True):
                raw = line.encode()
                if any(v.joined(x) != raw for v, x in zip(self.sides, found, strict=True)):
                    alone += own
                    continue
                stops = np.cumsum(np.fromiter((1 + len(w.encode()) for w in own), np.int64, len(own)))
                flat = [np.array(x, np.int64) for x in found]
                ends = [np.searchsorted(np.cumsum(v.sizes[x]), stops) + 1 for v, x in zip(self.sides, flat, strict=True)]
                learned.append((own, flat, [np.diff(e, prepend=0) for e in ends], np.zeros(len(own), bool)))
        for k in range(0, len(alone), TEXTS):
            some = alone[k : k + TEXTS]
            lines = [" " + w for w in some]
            found = [v.encode(lines) for v in self.sides]
            bad = [any(v.joined(x) != line.encode() for v, x in zip(self.sides, xs, strict=True)) for line, *xs in zip(lines, *found, strict=True)]
            sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in found]
            learned.append((some, [np.array([i for x in side for i in x], np.int64) for side in found], sizes, np.array(bad)))
        self.add(learned)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which texts are given back byte for byte, and the ids, on end, and numbers of ids of those, for both sides."""
        if len(self.place) > KEPT_WORDS:
            self.clear()
        words: list[str] = []
        counts = []
        for text in texts:
            own = _CUT.split(text)
            words += own
            counts.append(len(own))
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if len(miss := np.flatnonzero(at < 0).tolist()):
            self.learn(list(dict.fromkeys(words[i] for i in miss)))
            at[miss] = [self.place[words[i]] for i in miss]
        text_of = np.repeat(np.arange(len(texts)), counts)
        good = np.bincount(text_of, weights=self.bad[at], minlength=len(texts)) == 0
        use = good[text_of]
        at, text_of = at[use], text_of[use]
        out = []
        for ids, sizes in zip(self.ids, self.sizes, strict=True):
            own = sizes[at]
            starts, stops = (np.cumsum(sizes) - sizes)[at], np.cumsum(own)
            flat = ids[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - own), own)]
            out.append((flat, np.bincount(text_of, weights=own, minlength=len(texts)).astype(np.int64)[good]))
        for w in words:
            if len(w) > KEPT_CHARS:
                self.place.pop(w, None)  # its ids stay until all is cleared
        return good, out


@functools.cache
def _vocabularies(a_file: str, b_file: str) -> tuple[Words, list[str]]:
    words = Words(ByteLevel(a_file), Pieces(b_file))
    wide = max(len(v.sizes) for v in words.sides)
    return words, [f"{i}{mark}" for mark in ",|;" for i in range(wide)]


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d merged ends are of a, for each diagonal d; equal ends of a come first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # a[mid] is among the first d if it is not behind b[d - mid - 1].
        among = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonals - mid - 1, 0, len(b) - 1)])
        low = np.where(among, mid + 1, low)
        high = np.where(open_ & ~among, mid, high)
    return low


def merged_groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of a and of b, from their ends; both lists end at the same place."""
    n = len(a) + len(b)
    group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    if not n:
        return group_a, group_b
    starts = np.arange(0, n, piece)
    i = crossings(a, b, starts)
    j = starts - i
    owner_a, owner_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closed = np.zeros(len(starts), np.int64)
    for step in range(min(piece, n)):
        live = starts + step < n
        left, right = a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)]
        take_a = live & (i < len(a)) & ((left <= right) | (j >= len(b)))
        take_b = live & ~take_a
        at = np.flatnonzero(take_a)
        group_a[i[at]], owner_a[i[at]] = closed[at], at
        at = np.flatnonzero(take_b)
        group_b[j[at]], owner_b[j[at]] = closed[at], at
        # The overlap of two tokens that end together closes a group. It is counted with the b token, which comes second, also
        # where the diagonal parts the two.
        previous = a[np.maximum(i - 1, 0)]
        closed += take_b & (i > 0) & (previous == right)
        i, j = i + take_a, j + take_b
    before = np.cumsum(closed) - closed  # groups closed in earlier pieces
    return group_a + before[owner_a], group_b + before[owner_b]


def distinct_links(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, group_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of all links, each document's pair once; a pair is a's id << _SHIFT | b's id."""
    n, wide = len(group_doc), 2 * _SHIFT
    size_a, size_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    links = size_a * size_b
    small = np.flatnonzero(links <= GROUP_LINKS)
    counts = links[small]
    group = np.repeat(small, counts)
    k = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = size_b[group]
    keys = group_doc[group] << wide | ids_a[start_a[group] + k // own] << _SHIFT | ids_b[start_b[group] + k % own]
    keys, times = np.unique(keys, return_counts=True)
    more, more_times = [keys], [times]
    for g in np.flatnonzero(links > GROUP_LINKS).tolist():
        own_a, times_a = np.unique(ids_a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
        own_b, times_b = np.unique(ids_b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
        more.append((group_doc[g] << wide | own_a[:, None] << _SHIFT | own_b[None, :]).ravel())
        more_times.append(np.outer(times_a, times_b).ravel())
    if len(more) > 1:
        keys, place = np.unique(np.concatenate(more), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, place, np.concatenate(more_times))
    return keys >> wide, keys & (1 << wide) - 1, times


def align_texts(texts: list[str | None], words: Words, names: list[str]) -> dict:
    """Counts, group texts and distinct links of the documents of one block."""
    full = [k for k, t in enumerate(texts) if t]
    good, ((ids_a, n_a), (ids_b, n_b)) = words.encode([texts[k] for k in full])
    kept = [k for k, ok in zip(full, good.tolist(), strict=True) if ok]
    a, b = words.sides
    group_a, group_b = merged_groups(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]))
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    group_doc = np.zeros(groups, np.int64)
    group_doc[group_a] = np.repeat(np.arange(len(kept)), n_a)
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    n_groups = np.bincount(group_doc, minlength=len(kept))
    n_links = np.zeros(len(kept), np.int64)
    np.add.at(n_links, group_doc, size_a * size_b)
    doc, pair, times = distinct_links(ids_a, ids_b, group_a, group_b, group_doc)
    return {"kept": kept, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "doc": doc, "pair": pair, "times": times,
            "groups": group_texts(ids_a, ids_b, group_a, group_b, n_a + n_b, names)}


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: np.ndarray, names: list[str]) -> list[str]:
    """Each document's groups as `a1,a2|b1;a3|b2,b3`."""
    wide = len(names) // 3
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    place_a = np.arange(len(ids_a)) + (np.cumsum(count_b) - count_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(count_a)[group_b]
    last_a = np.append(group_a[1:] != group_a[:-1], True) if n else np.zeros(0, bool)
    last_b = np.append(group_b[1:] != group_b[:-1], True) if n else np.zeros(0, bool)
    line = np.empty(len(ids_a) + len(ids_b), np.int64)
    line[place_a] = ids_a + wide * last_a
    line[place_b] = ids_b + 2 * wide * last_b
    stops = np.cumsum(sizes).tolist()
    return ["".join(map(names.__getitem__, line[s:e].tolist()))[:-1] for s, e in zip([0, *stops], stops, strict=False)]


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers of 32 bits; the few times above that stay below 2^32 for any text of under 4 GB of links."""
    return x.astype("<u4").tobytes()


def _aligned(rows: DataFrame, a_file: str, b_file: str, block_chars: int, with_groups: bool) -> DataFrame:
    """Documents and, for each block, its distinct pairs; written. rows has the carried columns and then text."""
    own = [StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    ddl = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, times binary, pairs array<long>, docs array<int>"
    schema = StructType([*own, *_parse_datatype_string(ddl).fields])
    width = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = _vocabularies(a_file, b_file)
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(width)
            sizes = np.array(pc.fill_null(pc.utf8_length(texts), 0), np.int64)
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), block_chars, side="right")) + at)
                yield block_rows(batch.slice(at, stop - at), words, names, block)
                block, at = block + 1, stop

    def block_rows(part: pa.RecordBatch, words: Words, names: list[str], block: int) -> pa.RecordBatch:
        found = align_texts(part.column(width).to_pylist(), words, names)
        n = part.num_rows
        pairs, local, docs = np.unique(found["pair"], return_inverse=True, return_counts=True)
        cuts = np.searchsorted(found["doc"], np.arange(len(found["kept"]) + 1)).tolist()
        numbers = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        digests, texts, links, times = [""] * n, [""] * n, [b""] * n, [b""] * n
        for k, values in numbers.items():
            values[found["kept"]] = found[k]
        for i, k in enumerate(found["kept"]):
            digests[k] = hashlib.sha256(found["groups"][i].encode()).hexdigest()
            links[k], times[k] = _narrow(local[cuts[i] : cuts[i + 1]]), _narrow(found["times"][cuts[i] : cuts[i + 1]])
            texts[k] = found["groups"][i] if with_groups else ""
        kinds = [f.type for f in part.schema][:width]
        columns = [pa.concat_arrays([part.column(c), pa.nulls(1, kinds[c])]) for c in range(width)]
        columns.append(pa.array([block] * (n + 1), pa.int64()))
        columns += [pa.array([*v.tolist(), None], pa.int64()) for v in numbers.values()]
        columns += [pa.array([*v, None], t) for v, t in ((digests, pa.string()), (texts, pa.string()), (links, pa.binary()), (times, pa.binary()))]
        columns.append(pa.array([None] * n + [pairs], pa.list_(pa.int64())))
        columns.append(pa.array([None] * n + [docs.astype(np.int32)], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return cut_lineage(rows.mapInArrow(run, schema), "aligned")


def pair_counts(written: DataFrame) -> DataFrame:
    """pair, count (documents that link it) and best (whether it is its A id's highest count)."""
    each = written.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.*")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count"))
    counts = cut_lineage(counts.withColumn("a", F.shiftright("pair", _SHIFT)), "pair-counts")
    # A row for each id of the first vocabulary at most: small enough to broadcast at any size.
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _weighed(written: DataFrame, names: Sequence[str], with_groups: bool) -> DataFrame:
    """Documents with n_best and count_sum; each block's documents follow the counts of its pairs."""
    blocks = written.where("pairs IS NOT NULL").select("block", F.explode("pairs").alias("pair"))
    known = blocks.join(pair_counts(written), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))
    known = known.select("block", F.transform("known", lambda x: x["count"]).alias("counts"), F.transform("known", lambda x: x["best"]).alias("bests"))
    kept = [*names, "n_a", "n_b", "n_groups", "n_links"]
    last = ["groups_sha256"] + ["groups"] * with_groups
    docs = written.where("links IS NOT NULL").select("block", *kept, *last, "links", "times")
    rows = docs.withColumn("turn", F.lit(1)).unionByName(known.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    dealt = rows.repartition("block").sortWithinPartitions("block", "turn")
    order = [*kept, "n_best", "count_sum", *last]
    fields = {f.name: StructField(f.name, f.dataType) for f in docs.schema.fields} | {k: f for k, f in zip(("n_best", "count_sum"), _parse_datatype_string("a long, b long").fields, strict=True)}
    schema = StructType([StructField(c, fields[c].dataType) for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bests = np.empty(0, np.int64)
        for batch in batches:
            turns, links, times = batch.column("turn").to_pylist(), batch.column("links"), batch.column("times")
            at, best, total = [], [], []
            for i, turn in enumerate(turns):
                if turn == 0:
                    counts = np.array(batch.column("counts")[i].values, np.int64)
                    bests = np.array(batch.column("bests")[i].values.to_numpy(zero_copy_only=False), np.int64)
                    continue
                local = np.frombuffer(links[i].as_buffer(), "<u4") if links[i].as_buffer().size else np.empty(0, np.uint32)
                n = np.frombuffer(times[i].as_buffer(), "<u4").astype(np.int64) if len(local) else np.empty(0, np.int64)
                at.append(i)
                best.append(int(n @ bests[local]))
                total.append(int(n @ counts[local]))
            if at:
                own = {c: batch.column(c).take(pa.array(at, pa.int64())) for c in (*kept, *last)}
                own |= {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
                yield pa.RecordBatch.from_arrays([own[c] for c in order], names=order)

    return dealt.mapInArrow(run, schema)


def align(
    docs: DataFrame,
    a_file: str,
    b_file: str,
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    carry: Sequence[str] | None = None,
    with_groups: bool = False,
) -> DataFrame:
    """Columns of docs with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    a_file is a byte-level vocabulary, b_file a piece model with byte fallback. carry names the columns to keep, all by default.
    """
    small_batches(docs.sparkSession)
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    kept = [c for c in others(docs, new) if carry is None or c in carry]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*(docs[quoted(c)].alias(n) for c, n in zip(kept, names, strict=True)), docs[quoted(text)].alias("text"))
    written = _aligned(rows, a_file, b_file, block_chars, with_groups)
    return _weighed(written, names, with_groups).toDF(*kept, *new)
