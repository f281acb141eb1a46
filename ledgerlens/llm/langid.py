"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three characters of words padded by a blank) of a
language in order of frequency. A document goes to the language whose profile is nearest by
out-of-place distance: the sum, over the document's most frequent n-grams, of how far each stands from its
place in the profile, or the profile's length where the profile lacks it.

Defined cases: null text or no letter gives `und` with score 0; without any learned language all do;
ties go to the smaller language by code point; among equally frequent n-grams the smaller comes first.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.rows import quoted, small_batches, with_text_columns

UNKNOWN = "und"
PROFILE = 300
#: A language column is a closed set of labels; profiles are sent to every task, so their number is checked.
MAX_LANGUAGES = 10_000
BLANK = np.uint32(32)
_CHUNK = 1 << 21

Profiles = dict[str, np.ndarray]


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text, each packed into 63 bits; empty if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.empty(len(points) + 2, np.uint32)
    chars[0] = chars[-1] = BLANK
    chars[1:-1] = _letters()[points]
    blank = chars == BLANK
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    chars = chars[keep].astype(np.int64)
    if len(chars) < 3:
        return np.empty(0, np.int64)
    pairs = chars[:-1] << 21 | chars[1:]
    inner = chars[1:-1] != 32
    triples = (pairs[:-1] << 21 | chars[2:])[inner]
    return np.concatenate([chars[chars != 32], pairs, triples])


def ranked(grams: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    values, counts = np.unique(grams, return_counts=True)
    if len(values) > 4 * size:  # all that tie with the last place stay in
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))[:size]]


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """How often each n-gram occurs in the texts of each language: lang, gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(name: str, parts: list[np.ndarray]) -> None:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            if name in totals:
                both = np.concatenate([totals[name][0], values])
                weight = np.concatenate([totals[name][1], counts])
                values, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, weight, len(values)).astype(np.int64)
            totals[name] = (values, counts)

        for batch in batches:
            waiting, held = defaultdict(list), defaultdict(int)
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(grams := ngrams(body.as_py() or "")):
                    waiting[name].append(grams)
                    held[name] += len(grams)
                    if held[name] > _CHUNK:
                        add(name, waiting.pop(name))
                        held[name] = 0
            for name, parts in waiting.items():
                add(name, parts)
        for name, (values, counts) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(docs[quoted(lang)].alias("lang"), docs[quoted(text)].alias("text"))
    counted = rows.where("lang is not null and text is not null").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """The profile of each language, from the whole texts of all rows whose language is not null."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs, text, lang).withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    out: dict[str, list] = defaultdict(list)
    for row in top.limit(MAX_LANGUAGES * size + 1).toLocalIterator():
        out[row["lang"]].append((row["place"], row["gram"]))
        if len(out) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: this is no language column")
    return {k: np.array([g for _, g in sorted(out[k])], np.int64) for k in sorted(out, key=lambda x: x.encode())}


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: Profiles, size: int = PROFILE):
        self.names, self.size = list(profiles), size
        self.grams = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.places = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, grams in enumerate(profiles.values()):
            self.places[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """The distance to each profile and the number of n-grams compared; None if there is nothing to compare."""
        if not self.names or not len(grams := ranked(ngrams(text), self.size)):
            return None
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == grams, at, len(self.grams))
        places = self.places[at]
        away = np.abs(places - np.arange(len(grams))[:, None])
        return np.where(places < 0, self.size, np.minimum(away, self.size)).sum(axis=0), len(grams)

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language and a score: 1 less the distance over the largest possible one."""
        found = self.distances(text) if text else None
        if found is None:
            return UNKNOWN, 0.0
        distances, n = found
        best = int(distances.argmin())
        return self.names[best], float(1 - distances[best] / (n * self.size))


def identify(
    docs: DataFrame, profiles: Profiles, text: str = "text", carry: list[str] | None = None, size: int = PROFILE
) -> DataFrame:
    """Columns of docs with lang_pred and score; whole texts are read, nothing else is."""

    built: list[Ranker] = []

    def judged(texts: pa.Array) -> list:
        if not built:
            built.append(Ranker(profiles, size))
        found = [built[0].judge(x.as_py()) for x in texts]
        return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

    return with_text_columns(docs, text, "lang_pred string, score double", judged, carry)
