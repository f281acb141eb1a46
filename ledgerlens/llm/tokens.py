"""Token-id files compressed by Re-Pair grammars.

Documents are range-partitioned by id and encoded; each task cuts its ids into shards of whole documents.
In a shard frequent pairs of ids are repeatedly replaced by nonterminals: each round counts all pairs, makes
the most frequent ones rules, and replaces their occurrences from left to right, until no pair occurs LEAST
times, so that every rule saves more ids than it stores. A shard row of the file holds its rules, the expansion
length of each rule, the remaining symbols, and its documents' ids and lengths, so any document, and any stretch of ids, is decoded without the rest.

Files: `shards` (Parquet; part, seq, before = ids of earlier shards of the part, n_tokens, doc_ids, lengths,
rules, expansions, symbols as little-endian unsigned 32-bit integers) and `parts` (part, start).

Encoding is the tokenizers library's. Byte-level pre-tokenisation always starts a new piece at a single blank or
line break between two characters that are not white space, and at a full stop, a comma or some other marks
behind a letter or digit; texts are cut there and each different piece is encoded once in a worker for as long as it is kept, about
KEPT_PIECES at most. Pieces that are one word go to the tokenizer's model as the letters that stand for their bytes.

Defined cases: null text is empty; every document ends with the end id; equal ids are ordered by text hash,
null ids come first; no pair crosses the end of a document; an empty table writes empty files. A shard
holds at least one whole document, so the longest text bounds its memory.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ledgerlens.llm.rows import quoted, small_batches
from ledgerlens.session import shuffles_freed

END = 0
SHARD_TOKENS = 1 << 19
#: Rules made in a round at most, and the fewest occurrences of a pair: a rule stores two ids and saves one for each.
RULES = 4096
LEAST = 3
#: Pieces kept with their ids in a worker, and the longest piece kept; others are encoded anew.
KEPT_PIECES, KEPT_CHARS = 800_000, 64
_LEARN, _JOINED = 8192, 256
_SLOT_BITS = 18
_CUT = re.compile(r"(?<=\S) (?=\S)")
# White space other than the blank and the line break, and the mark used for cutting.
_OTHER_SPACE = re.compile("[\x00\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Digits and letters that all versions of Unicode agree on.
_PLAIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481"
_STARTS = (" ", "\n")
_MARK = "\0"
_WORD = re.compile("[ \n]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481]+").fullmatch
_STOP = re.compile(f"(?<=[{_PLAIN}])(?=[.,])")
_OTHER_STOP = re.compile(f"[.,](?<=[^{_PLAIN}][.,])")
# The same for Arrow's expressions, which spell code points their own way.
_OTHER_SPACES, _OTHER_STOPS = (
    re.sub("[^\n -~]", lambda m: f"\\x{{{ord(m[0]):x}}}", x) for x in (f"  | \n|\n |{_OTHER_SPACE.pattern}", f"^[.,]|[^{_PLAIN}][.,]")
)
# The bytes that begin a piece in all other texts; a line break does where no two touch.
_BEGINS = np.isin(np.arange(256), [ord(x) for x in " \n.,"])
# These marks do behind a letter or digit; others may be part of a special token.
_WORDS = np.array([x < 128 and chr(x).isalnum() for x in range(256)])
_MARKS = np.isin(np.arange(256), [ord(x) for x in '!"#$%&)*:;?'])


def marked(text: str) -> str:
    """The text with a mark before each piece but the first; it holds no mark itself."""
    if "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
        return _CUT.sub(_MARK + " ", text)
    # Every blank stands alone, and so does every line break where no two follow each other.
    if text[:1] in (".", ",") or _OTHER_STOP.search(text):
        text = _STOP.sub(_MARK, text)
    else:
        text = text.replace(".", "\0.").replace(",", "\0,")
    if "\n\n" not in text:
        text = text.replace("\n", "\0\n")
    return text.replace(" ", "\0 ")


def cut(text: str) -> list[str]:
    """The text in pieces that are encoded on their own; each but the first starts with its blank."""
    if _MARK in text:
        out = _CUT.split(text)
        return out[:1] + [" " + x for x in out[1:]]
    return marked(text).split(_MARK)


def cut_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts on end, and the number of pieces of each text."""
    texts = texts.cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    begins = _BEGINS[raw]
    marks = np.flatnonzero(_MARKS[raw])
    marks = marks[marks > 0]
    begins[marks[_WORDS[raw[marks - 1]]]] = True
    lines = np.flatnonzero(raw == ord("\n"))
    touching = lines[:-1][np.diff(lines) == 1]
    begins[touching] = begins[touching + 1] = False
    # Texts with other white space, with blanks that do not stand alone, or with stops behind other characters are cut one by one.
    other = pc.or_(pc.match_substring_regex(texts, _OTHER_SPACES), pc.match_substring_regex(texts, _OTHER_STOPS))
    for i in np.flatnonzero(other.to_numpy(zero_copy_only=False)).tolist():
        own = np.cumsum([len(x.encode()) for x in cut(texts[i].as_py())])
        begins[edges[i] : edges[i + 1]] = False
        begins[edges[i] + own[:-1][own[:-1] < own[-1]]] = True
    begins[edges[:-1][edges[:-1] < edges[1:]]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(raw)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)), np.diff(np.searchsorted(starts, edges))


def load_tokenizer(file: str) -> Tokenizer:
    """The tokenizer without threads of its own: a task has one core, and its neighbours need the others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(file)


def byte_letters() -> np.ndarray:
    """The code point that stands for each byte in byte-level vocabularies; the byte 0 stays, as a mark."""
    shown = np.zeros(256, bool)
    for a, b in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)):
        shown[a : b + 1] = True
    letters = np.where(shown, np.arange(256), 255 + np.cumsum(~shown)).astype("<u4")
    letters[0] = 0
    return letters


_BYTE_LETTERS = byte_letters()


@functools.cache
def _tokenizer(file: str) -> tuple[Tokenizer, Tokenizer, np.ndarray]:
    """The tokenizer, one with its model for marked byte letters, and the number of bytes each id stands for."""
    tokenizer = load_tokenizer(file)
    tokenizer.model._resize_cache(0)  # no piece comes twice
    letters = Tokenizer(tokenizer.model)
    letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_MARK)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # byte-level: a character for each byte
    return tokenizer, letters, sizes


def _utf8_ends(pieces: list[str]) -> np.ndarray:
    """Where each piece ends in the bytes of all on end."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    stops = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    return stops[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) - 1]


class Encoder:
    """Ids of texts; each different piece is encoded once."""

    def __init__(self, file: str):
        self.tokenizer, self.letters, self.bytes_of = _tokenizer(file)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0
        self.seen = np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the pieces seen most, half of them at most; they are the ones that come again."""
        often = np.sort(self.seen)[: -KEPT_PIECES // 2 or None][-1:].max(initial=1)
        kept = [(x, i) for x, i in self.place.items() if self.seen[i] > often]
        at = np.fromiter((i for _, i in kept), np.int64, len(kept))
        ids, sizes = self.ids_of(at)
        self.place = {x: k for k, (x, _) in enumerate(kept)}
        self.flat, self.used = (ids if len(ids) else np.empty(1 << 16, np.uint32)), len(ids)
        self.sizes, self.starts, self.count = sizes, np.cumsum(sizes) - sizes, len(kept)
        if not kept:
            return self.clear()
        self.seen = np.ones(len(kept), np.int64)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces on end, and the number of ids of each."""
        sizes = self.sizes[at]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[at] - (stops - sizes), sizes)], sizes

    def learn(self, pieces: list[str]) -> None:
        """Encode new, different pieces, many in one string; the ids' bytes tell where a piece ends."""
        # A word needs no pre-tokeniser. Of the others, those with one blank or line break in front and no other white
        # space at the ends may stand between others.
        words, joinable, alone = [], [], []
        for x in pieces:
            if _WORD(x):
                words.append(x)
            else:
                (joinable if x[:1] in _STARTS and x.strip() == x[1:] != "" else alone).append(x)
        if alone:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.add(alone, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        if joinable:
            self.add_joined(joinable, self.tokenizer, joinable, "")
        if words:
            # A line break is a token of its own, a blank belongs to its word.
            raw = np.frombuffer(_MARK.join(words).replace("\n", "\n" + _MARK).encode(), np.uint8)
            self.add_joined(words, self.letters, _BYTE_LETTERS[raw].tobytes().decode("utf-32-le").split(_MARK), _MARK)

    def add_joined(self, pieces: list[str], tokenizer: Tokenizer, parts: list[str], mark: str) -> None:
        """Encode pieces, cut into parts, many in one string."""
        joined = [mark.join(parts[k : k + _JOINED]) for k in range(0, len(parts), _JOINED)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        stops = np.searchsorted(np.cumsum(self.bytes_of[flat]), _utf8_ends(pieces)) + 1
        self.add(pieces, flat, np.diff(np.concatenate([[0], stops])))

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        more = len(ids)
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(pieces) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
        self.flat[self.used : self.used + more] = ids
        at = slice(self.count, self.count + len(pieces))
        self.sizes[at], self.starts[at] = sizes, self.used + np.cumsum(sizes) - sizes
        self.place.update(zip(pieces, range(at.start, at.stop), strict=True))
        self.used, self.count = self.used + more, at.stop

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, without an end id, and the number of ids of each."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        if len(self.place) > KEPT_PIECES:
            self.trim()
        pieces, counts = cut_all(texts)
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.place.get, different, repeat(-1)), np.int64, len(different))
        if len(miss := np.flatnonzero(known < 0)):
            new = [different[i] for i in miss.tolist()]
            for k in range(0, len(new), _LEARN):  # the library's results are large
                self.learn(new[k : k + _LEARN])
            known[miss] = [self.place[x] for x in new]
            for x in new:
                if len(x) > KEPT_CHARS:
                    del self.place[x]
        at = known[coded.indices.to_numpy()]
        seen = np.bincount(at, minlength=self.count)
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        ids, sizes = self.ids_of(at)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return ids, np.diff(np.concatenate([[0], ends]))


@functools.cache
def _encoder(file: str) -> Encoder:
    """One encoder for the tasks that a worker runs one after another; it keeps its pieces, and ids do not depend on them."""
    return Encoder(file)


def compress(ids: np.ndarray, end: int = END, rounds: int | None = None, rules: int = RULES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs; rule k makes the symbol max(ids) + 1 + k) and the remaining symbols."""
    base, grammar = int(ids.max(initial=0)) + 1, []
    # The ids that occur are numbered anew in their order, few enough for a pair of symbols to fit into 32 bits.
    occurs = np.bincount(ids, minlength=base) > 0
    present, number = np.flatnonzero(occurs).astype(np.uint32), (np.cumsum(occurs) - 1).astype(np.uint32)
    seq, symbol = number[ids], len(present)
    end = int(number[end]) if end < base and occurs[end] else -1
    # Where a pair may still occur `least` times: a count of known symbols only falls, so once too rare is always too rare.
    alive = (seq[:-1] != end) & (seq[1:] != end)
    while len(seq) > 1 and (rounds is None or len(grammar) < rounds):
        # A pair is one number, of 32 bits where all symbols fit into 16.
        key, bits = (np.uint32, 16) if symbol <= 1 << 16 else (np.uint64, 32)
        keys = seq[:-1].astype(key)
        keys <<= key(bits)
        keys |= seq[1:]
        living = np.flatnonzero(alive)
        keys = keys[living]
        ordered = np.sort(keys)
        if not len(ordered):
            break
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.concatenate([edge, [len(ordered)]]))
        if not (counts >= least).any():
            break
        frequent = np.flatnonzero(counts >= least)
        often = frequent[np.argsort(-counts[frequent], kind="stable")[:rules]]
        chosen = np.sort(ordered[edge[often]])
        # Few positions hold a chosen or frequent pair; a table of hashes tells most others at once.
        table = np.zeros(1 << _SLOT_BITS, np.uint8)
        table[_slot(ordered[edge[frequent]])] = 1
        table[_slot(chosen)] = 2
        slots = _slot(keys)
        state = table[slots]
        alive[living] = state > 0
        maybe = np.flatnonzero(state == 2)
        slots, wanted, maybe = slots[maybe], keys[maybe], living[maybe]
        # The last chosen pair of each slot is nearly always the one; the others are searched for.
        last = np.zeros(1 << _SLOT_BITS, np.int32)
        last[_slot(chosen)] = np.arange(len(chosen))
        which = last[slots]
        other = np.flatnonzero(chosen[which] != wanted)
        which[other] = np.minimum(np.searchsorted(chosen, wanted[other]), len(chosen) - 1)
        hit = chosen[which] == wanted
        places, which = maybe[hit], which[hit]
        # In a run of touching pairs every other one is replaced.
        first = np.concatenate([[True], np.diff(places) != 1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
        take = (np.arange(len(places)) - start) & 1 == 0
        places, which = places[take], which[take]
        # Touching pairs take occurrences from each other; a pair left with too few waits for a later round.
        worth = np.bincount(which, minlength=len(chosen)) >= least
        if worth.any():
            stays = worth[which]
            places, which = places[stays], (np.cumsum(worth) - 1)[which[stays]]
            chosen = chosen[worth]
        seq[places] = symbol + which
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq = seq[keep]
        # The pair that starts at a kept symbol lives on; pairs with a new symbol come to life.
        alive = alive[keep[:-1]] if keep[-1] else np.append(alive[keep[:-1]], False)
        alive = alive[: len(seq) - 1]
        fresh = places - np.arange(len(places))
        fresh = np.concatenate([fresh[fresh > 0] - 1, fresh[fresh < len(seq) - 1]])
        alive[fresh] = (seq[fresh] != end) & (seq[fresh + 1] != end)
        grammar.append(np.stack([chosen >> key(bits), chosen & key((1 << bits) - 1)], axis=1).astype(np.uint32))
        symbol += len(chosen)
    pairs = np.concatenate(grammar) if grammar else np.empty((0, 2), np.uint32)
    names = np.concatenate([present, np.arange(base, base + len(pairs), dtype=np.uint32)])
    return np.concatenate([[[base, 0]], names[pairs]]).astype(np.uint32), names[seq]


def _slot(keys: np.ndarray) -> np.ndarray:
    """Hashes of a few bits."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def expansions(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for. The first row of rules holds the first nonterminal."""
    base, out = int(rules[0, 0]), []
    for a, b in rules[1:].tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def expand(rules: np.ndarray, symbols: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for.

    Where lengths, the rules' expansion lengths, say that the bodies of all rules are shorter than the result, each is
    expanded once and copied; else the symbols are expanded level by level.
    """
    base = int(rules[0, 0])
    if lengths is not None and len(lengths):
        bodies = int(lengths.sum(dtype=np.int64))
        inner = symbols >= base
        which = symbols[inner].astype(np.int64) - base
        total = int(lengths[which].sum(dtype=np.int64)) + len(symbols) - len(which)
        if bodies <= total:
            flat = expand(rules, np.arange(base, base + len(lengths), dtype=np.uint32))
            sizes = np.ones(len(symbols), np.int32)
            sizes[inner] = lengths[which]
            # Where each symbol's body lies: single ids behind the bodies of the rules.
            source = np.empty(len(symbols), np.int32)
            source[inner] = (np.cumsum(lengths, dtype=np.int64) - lengths)[which]
            source[~inner] = bodies + np.arange(len(symbols) - len(which))
            source -= np.cumsum(sizes, dtype=np.int32) - sizes
            return np.concatenate([flat, symbols[~inner]])[np.repeat(source, sizes) + np.arange(total, dtype=np.int32)]
    while len(symbols) and (inner := symbols >= base).any():
        at = np.arange(len(symbols)) + np.cumsum(inner) - inner
        out = np.empty(len(symbols) + int(inner.sum()), np.uint32)
        pair = rules[1 + symbols[inner].astype(np.int64) - base]
        out[at[~inner]] = symbols[~inner]
        out[at[inner]], out[at[inner] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def stretch(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a shard; only the symbols that make them are expanded."""
    base = int(rules[0, 0])
    sizes = np.where(symbols >= base, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(sizes)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    skipped = int(ends[a] - sizes[a]) if a < len(ends) else start
    return expand(rules, symbols[a:b])[start - skipped : stop - skipped]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS, rounds: int | None = None
) -> str:
    """Encode the documents in ascending id order and write the files below path; the path."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(docs[quoted(doc_id)].alias("doc_id"), F.coalesce(docs[quoted(text)], F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = (f"part int, seq int, before long, n_tokens long, doc_ids array<{kind}>, lengths array<int>, "
              "rules binary, expansions binary, symbols binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        seq = before = waiting = 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        id_type = None

        def shard() -> pa.RecordBatch:
            rules, symbols = compress(np.concatenate(held), rounds=rounds)
            row = [part, seq, before, waiting, keys, np.concatenate(sizes), rules.tobytes(), expansions(rules).tobytes(), symbols.tobytes()]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            chars = np.cumsum(pc.utf8_length(texts).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(ids):
                to = np.searchsorted(chars, 2 * shard_tokens + (chars[at - 1] if at else 0))
                some = texts[at : int(to) + 1]
                found, counts = encoder.encode(some)
                stops = np.cumsum(counts)
                flat = np.insert(found, stops, END)  # the end id behind each document
                keys += ids[at : at + len(some)]
                held.append(flat)
                sizes.append((counts + 1).astype(np.int32))
                waiting += len(flat)
                at += len(some)
                if waiting >= shard_tokens:
                    yield shard()
                    seq, before, waiting, keys, held, sizes = seq + 1, before + waiting, 0, [], [], []
        if waiting:
            yield shard()

    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with shuffles_freed(spark):
        ranged.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/shards")
        totals = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row a task
        starts, at = [], 0
        for row in sorted(totals):
            starts.append((row["part"], at))
            at += row["n"]
        spark.createDataFrame(starts, "part int, start long").coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document, decoded from the files."""
    shards = spark.read.parquet(f"{path}/shards").join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    rows = shards.select("start", "before", "doc_ids", "lengths", "rules", "symbols", "expansions")
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, before, keys, lengths, rules, symbols, sizes_of = (batch.column(c)[i] for c in range(7))
                grammar = np.frombuffer(rules.as_py(), np.uint32).reshape(-1, 2)
                ids = expand(grammar, np.frombuffer(symbols.as_py(), np.uint32), np.frombuffer(sizes_of.as_py(), np.uint32))
                sizes = np.array(lengths.as_py(), np.int64)
                stops = np.cumsum(sizes)
                raw, spans = ids.astype("<u4"), list(zip((stops - sizes).tolist(), stops.tolist(), strict=True))
                out = [keys.values, pa.array(start.as_py() + before.as_py() + stops - sizes), pa.array(sizes),
                       pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    out.append(pa.array([raw[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)
