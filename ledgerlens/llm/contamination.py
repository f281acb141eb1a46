"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

Texts are normalised to words (digits, a-z after lower-casing A-Z, and everything beyond ASCII) with one
blank between them. The automaton holds every window of WINDOW words of the benchmark items; a shorter
item is one window. Each document is scanned once; offsets of hits are mapped back to the original text.

Defined cases: null and wordless texts have no words and are clean; wordless items have no window; rows of
the benchmark with one id are one item; a null item id is read as the empty string.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.rows import quoted, with_text_columns
from ledgerlens.session import cut_lineage

WINDOW = 13
#: Bytes of items in one automaton, some 300 MB with its windows. A larger benchmark takes several passes.
BLOCK_BYTES = 1 << 20
# Bytes that belong to words, lower-cased; all others become blanks.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
_SPANS = "array<struct<first:int,last:int,start:int,stop:int>>"


def normal(text: str | None) -> str:
    """Words with one blank around each; one character for each byte of UTF-8."""
    words = (text or "").encode("utf-8", "replace").translate(_WORD).split()
    return " " + b" ".join(words).decode("latin-1") + " " if words else " "


def automaton(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    """All windows of the items, each with the ids of the items that hold it; None if there is none."""
    holders: dict[str, set[str]] = defaultdict(set)
    for item, text in items:
        words = normal(text).split(" ")[1:-1]
        for k in range(max(1, len(words) - window + 1) if words else 0):
            holders[" ".join(words[k : k + window])].add(item)
    if not holders:
        return None
    found = ahocorasick.Automaton()
    for words, ids in holders.items():
        found.add_word(f" {words} ", (words.count(" ") + 1, sorted(ids)))
    found.make_automaton()
    return found


def hits(text: str | None, found: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, runs [first, last] of hit words, ids of the items with occurring windows."""
    body = normal(text)
    n, ids, ends, lengths = body.count(" ") - 1, set(), [], []
    for end, (size, holders) in found.iter(body) if found and n else ():
        ids.update(holders)
        ends.append(end)
        lengths.append(size)
    if not ends:
        return n, [], ids
    blanks = np.flatnonzero(np.frombuffer(body.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(blanks, ends) - 1  # the word before the blank that ends the match
    return n, joined(zip((last - np.array(lengths) + 1).tolist(), last.tolist(), strict=True)), ids


def joined(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words that touch or overlap, made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def located(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words with their place in the original text, in code points."""
    if not runs:
        return []
    raw = text.encode("utf-8", "replace")
    spots = [m.span() for m in _RUN.finditer(raw.translate(_WORD))]
    out = []
    for first, last in runs:
        a, b = spots[first][0], spots[last][1]
        start = len(raw[:a].decode("utf-8"))
        out.append({"first": first, "last": last, "start": start, "stop": start + len(raw[a:b].decode("utf-8"))})
    return out


def item_blocks(
    benchmark: DataFrame, item: str, text: str, block_bytes: int
) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """How many blocks of bounded size the items make, and the blocks; the driver holds one at a time."""
    rows = benchmark.select(
        F.coalesce(benchmark[quoted(item)].cast("string"), F.lit("")).alias("item"), benchmark[quoted(text)].alias("text")
    ).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return n, ([(r["item"], r["text"]) for r in rows.where(F.col("block") == k).collect()] for k in range(n))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns of docs with n_words, n_hit, item_ids (sorted), and spans of hit words in the original text.

    A benchmark above block_bytes is taken block by block: each pass adds its hits to the documents, and the
    table is written between passes, so memory stays bounded and no document is compared pair by pair.
    """
    added = f"n_words long, n_hit long, item_ids array<string>, spans {_SPANS}"
    n, items = item_blocks(benchmark, item, item_text, block_bytes)
    if n == 1:
        return with_text_columns(docs, text, added, _scan(next(items), window), carry)
    kept = docs.columns if carry is None else list(carry)
    out, passes = docs, [f"pass_{k}_of_hits" for k in range(n)]
    for k, block in enumerate(items):
        ddl = f"{passes[k]} struct<n_words:long,item_ids:array<string>,spans:{_SPANS}>"
        step = with_text_columns(out, text, ddl, _struct_scan(block, window), [*kept, text, *passes[:k]])
        out = cut_lineage(step, "contamination")
    return with_text_columns(out.withColumn("all_hits", F.array(*passes)), "all_hits", added, _merge, kept)


def _columns(rows: list[tuple]) -> list:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()),
             pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "stop")])))
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def _scanner(items: list, window: int):
    """A function from texts to rows that builds its automaton once in a task."""
    built: list = []

    def run(texts: pa.Array) -> list[tuple]:
        if not built:
            built.append(automaton(items, window))
        out = []
        for x in texts:
            body = x.as_py()
            n, runs, ids = hits(body, built[0])
            out.append((n, sum(b - a + 1 for a, b in runs), sorted(ids), located(body, runs) if runs else []))
        return out

    return run


def _scan(items: list, window: int):
    rows = _scanner(items, window)
    return lambda texts: _columns(rows(texts))


def _struct_scan(items: list, window: int):
    rows = _scanner(items, window)

    def run(texts: pa.Array) -> list:
        n, _, ids, spans = _columns(rows(texts))
        return [pa.StructArray.from_arrays([n, ids, spans], names=["n_words", "item_ids", "spans"])]

    return run


def _merge(passes: pa.Array) -> list:
    rows = []
    for found in passes.to_pylist():
        ids = sorted({i for p in found for i in p["item_ids"]})
        runs: list[dict] = []
        for s in sorted((s for p in found for s in p["spans"]), key=lambda s: s["first"]):
            if runs and s["first"] <= runs[-1]["last"] + 1:
                if s["last"] > runs[-1]["last"]:
                    runs[-1] = runs[-1] | {"last": s["last"], "stop": s["stop"]}
            else:
                runs.append(s)
        rows.append((found[0]["n_words"], sum(s["last"] - s["first"] + 1 for s in runs), ids, runs))
    return _columns(rows)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
