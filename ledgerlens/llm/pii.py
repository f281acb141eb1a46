"""Personal data, and information-theoretic sanitisation of the terms around it.

Base patterns find emails, ip addresses, card and phone numbers: the protected entities. Corpus
co-occurrence then tells which terms reveal them. With N documents, n(e) and n(t) of them holding entity e and
term t, and n(t, e) of them holding t near e in c(t, e) different contexts,

    disclosure(t, e) = log2((1 - D / c(t, e)) n(t, e) N / (n(t) n(e))) / log2(N / n(e))

is the share of e's information that t gives away: nearly 1 if t only ever occurs near e, 0 if t is independent
of e. D is the absolute discount of pairs seen seldom, n1 / (n1 + 2 n2) with n1 pairs seen in one context and
n2 in two (Ney's estimate): entities mentioned once or twice are scored too, the lower the less pairs come back
in this corpus, and not at all where none does (D = 1). Terms are removed if their disclosure reaches REMOVE
and generalised if it reaches GENERALISE, wherever they occur. Copies of one passage are one context, so
duplication reveals no more than one mention does.

Matches of each kind are leftmost and do not overlap; one that fails its check is dropped and not retried.
Offsets are code points. Defined cases: null text is empty and has no spans; entities in every document
carry no information and protect nothing; repeated rows get the same spans; candidate and disclosing terms
beyond BLOCK_TERMS are worked through in several passes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.rows import quoted, small_batches, with_text_columns
from ledgerlens.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 8
GENERALISE, REMOVE = 0.5, 0.8
#: Terms sent to tasks at once.
BLOCK_TERMS = 500_000
# The characters of an email's local part, and the patterns.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,}")
_TAG = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its characters before an @, so no start is tried twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _context(text: str, a: int, b: int, reach: int) -> list[str]:
    """The terms among the words around a span, the nearest `reach` on either side."""
    width = 32 * reach
    return _TERM.findall(text[max(0, a - width) : a].lower())[-reach:] + _TERM.findall(text[b : b + width].lower())[:reach]


def entity_terms(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """entity, term, context, first: which terms stand near which entity; term null once per document and entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                body = value.as_py() or ""
                seen: dict[str, set[str]] = {}
                for a, k, b in base_spans(body):
                    entity = f"{KINDS[k]}:{body[a:b].lower()}"
                    if entity not in seen:
                        seen[entity] = set()
                        rows.append((entity, None, None, 1))
                    words = _context(body, a, b, reach)
                    mark = int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)
                    for term in sorted(set(words)):
                        rows.append((entity, term, mark, int(term not in seen[entity])))
                        seen[entity].add(term)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["entity", "term", "context", "first"]
            )

    return docs.select(docs[quoted(text)].alias("text")).mapInArrow(run, "entity string, term string, context long, first int")


def _blocks(terms: DataFrame, columns: list[str], block_terms: int) -> Iterator[list]:
    """Rows of a table of terms in blocks of bounded size, one at a time; at least one."""
    n = max(1, -(-terms.count() // block_terms))
    for k in range(n):
        yield terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).select(*columns).collect()


def document_counts(docs: DataFrame, text: str, terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """term, n_t: in how many documents each of the given terms occurs."""
    slim, counted = docs.select(docs[quoted(text)].alias("text")), None
    for block in _blocks(terms, ["term"], block_terms):
        wanted = frozenset(r["term"] for r in block)

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches if wanted else ():
                for value in batch.column(0):
                    found.update(wanted.intersection(_TERM.findall((value.as_py() or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        part = slim.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
        counted = part if counted is None else counted.union(part)
    return counted


def disclosing_terms(
    docs: DataFrame,
    text: str = "text",
    reach: int = REACH,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """term, disclosure (the largest over its entities) and action, from the whole corpus."""
    small_batches(docs.sparkSession)
    near = cut_lineage(entity_terms(docs, text, reach), "entity-terms")
    total = docs.count()
    entities = near.where("term is null").groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = near.where("term is not null").groupBy("entity", "term").agg(
        F.countDistinct("context").alias("contexts"), F.sum("first").alias("n_te")
    )
    pairs = cut_lineage(pairs, "entity-pairs")
    seen = pairs.agg(*(F.count_if(F.col("contexts") == k).alias(f"n{k}") for k in (1, 2))).first()
    discount = seen["n1"] / max(1, seen["n1"] + 2 * seen["n2"])
    left = F.lit(1.0) - F.lit(discount) / F.col("contexts")
    worth = F.log2(F.lit(float(total)) / F.col("n_e"))
    pairs = pairs.where(left > 0).join(entities.where(F.col("n_e") < total), "entity")
    # A term occurs in n_te documents at least, so pairs that cannot reach the threshold need no count.
    pairs = cut_lineage(pairs.where(F.log2(left) >= (generalise - 1) * worth - 1e-9), "entity-candidates")
    known = document_counts(docs, text, pairs.select("term").distinct(), block_terms)
    share = F.log2(left * F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e"))) / worth
    scored = pairs.join(known, "term")
    scored = scored.groupBy("term").agg(F.max(share).alias("disclosure")).where(F.col("disclosure") >= generalise)
    return scored.withColumn("action", F.when(F.col("disclosure") >= remove, F.lit("remove")).otherwise(F.lit("generalise")))


def _term_spans(text: str, actions: dict[str, str], base: list[Span]) -> list[tuple[int, int, int, str]]:
    low = text.lower()
    if not actions or len(low) != len(text) or actions.keys().isdisjoint(_TERM.findall(low)):
        if len(low) == len(text):
            return []
    out, k = [], 0
    for m in _TERM.finditer(text):
        act = actions.get(m[0].lower())
        if act:
            while k < len(base) and base[k][2] <= m.start():
                k += 1
            if all(b <= m.start() or a >= m.end() for a, _, b in base[k:]):
                out.append((m.start(), 4, m.end(), act))
    return out


def sanitise(
    docs: DataFrame,
    text: str = "text",
    terms: DataFrame | None = None,
    carry: list[str] | None = None,
    with_text: bool = True,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Columns of docs with n_email, n_ip, n_card, n_phone, base_spans, spans and, if asked for, clean_text.

    terms is a table of disclosing terms, that of docs itself by default. Spans are `kind:start:end`, joined by commas.
    """
    terms = cut_lineage(disclosing_terms(docs, text) if terms is None else terms, "disclosing-terms")
    added = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string" + ", clean_text string" * with_text
    found = list(_blocks(terms, ["term", "action"], block_terms)) if terms.count() <= block_terms else None
    kept = docs.columns if carry is None else list(carry)
    if found:
        actions = {r["term"]: r["action"] for r in found[0]}
        return with_text_columns(docs, text, added, lambda texts: _judged([(x.as_py() or "", None) for x in texts], actions, with_text), carry)
    out, passes = docs, []
    for k, block in enumerate(_blocks(terms, ["term", "action"], block_terms)):
        actions = {r["term"]: r["action"] for r in block}
        passes.append(f"pass_{k}_of_terms")
        ddl = f"{passes[-1]} array<struct<start:int,kind:int,stop:int,action:string>>"
        out = cut_lineage(with_text_columns(out, text, ddl, _term_pass(actions), [*kept, text, *passes[:-1]]), "sanitise")
    both = out.withColumn("text_and_terms", F.struct(F.col(quoted(text)).alias("text"), F.concat(*passes).alias("terms")))

    def merge(rows: pa.Array) -> list:
        return _judged([(r["text"] or "", [tuple(t.values()) for t in r["terms"]]) for r in rows.to_pylist()], {}, with_text)

    return with_text_columns(both, "text_and_terms", added, merge, kept)


def _term_pass(actions: dict[str, str]):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("action", pa.string())]))

    def run(texts: pa.Array) -> list:
        out = []
        for x in texts:
            body = x.as_py() or ""
            out.append([dict(zip(("start", "kind", "stop", "action"), s, strict=True)) for s in _term_spans(body, actions, base_spans(body))])
        return [pa.array(out, kind)]

    return run


def _judged(rows: list[tuple], actions: dict[str, str], with_text: bool) -> list:
    out = []
    for body, given in rows:
        base = base_spans(body)
        extra = _term_spans(body, actions, base) if given is None else given
        spans = sorted(base + [s[:3] for s in extra])
        row = [*(sum(k == i for _, k, _ in base) for i in range(4)), digest_text(base), digest_text(spans)]
        out.append((*row, _cleaned(body, base, extra)) if with_text else tuple(row))
    kinds = [pa.int64()] * 4 + [pa.string()] * (2 + with_text)
    return [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]


def _cleaned(text: str, base: list[Span], terms: list[tuple]) -> str:
    """Entities become their kind, generalised terms the word TERM, removed ones nothing."""
    marks = sorted([(a, b, _TAG[KINDS[k]]) for a, k, b in base] + [(a, b, "[TERM]" if act == "generalise" else "") for a, _, b, act in terms])
    out, at = [], 0
    for a, b, mark in marks:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
