"""Secrets in texts: base patterns, and credentials told from examples by who owns them across the corpus.

Base spans come from three patterns, each leftmost and without overlaps within its kind. Candidates are runs of
letters, digits and `+_-` of twelve or more characters with a letter and a digit. Their hashes are counted over the
whole corpus: in how many repositories and with how many owners each one occurs, and whether it stands inside a base
span anywhere. A hash that more than MAX_OWNERS owners or more than MAX_REPOSITORIES repositories hold is a widely
copied example. Any other one is owner-specific; it is taken for a live credential if some document names it as one
(it stands in a base span there) or if it looks random (LOOKS). Each occurrence of a live credential outside base spans becomes a span of kind `owned`. Base spans stay whatever the count says.

Everything is DataFrame functions. Texts are read once: matches leave as lengths of the pieces between them, and a
window over one document's matches turns lengths into places. Occurrences of a hash are reduced to distinct (hash, owner,
repository) rows with map-side combine before they are counted, so a string that a third of all documents hold is a few rows
for each task; verdicts meet occurrences in a join that Spark splits where one hash is hot.

Defined cases: null text is empty; a text of any length is one row of lengths; a null owner or repository is one like any
other; repeated rows keep their own spans and count as copies; an empty table gives no rows; columns whose names clash with new ones give way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.rows import others, quoted
from ledgerlens.session import cut_lineage

# The base patterns, and the least length of what they must match.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
# A run of the class is one match, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "owned")

#: Candidates: runs that hold a letter and a digit. Each run is tried once, at its start.
CANDIDATE = (
    r"(?<![A-Za-z0-9+_-])(?=[A-Za-z+_-]*+[0-9])(?=[0-9+_-]*+[A-Za-z])[A-Za-z0-9+_-]{12,}+"
)
#: What looks random: so many characters, digits, letters and different characters.
LOOKS = {"length": 16, "digits": 4, "letters": 4, "different": 8}
MAX_OWNERS = 2
MAX_REPOSITORIES = 20


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (kind, at, gap, size, value): each match with the length of the text since the one before."""
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(pieces.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    found = F.filter(zipped, lambda m: m["value"].isNotNull())
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), m["gap"].alias("gap"), F.length(m["value"]).alias("size"), m["value"].alias("value")
        ),
    )


def looks_random(value: Column, looks: dict[str, int] = LOOKS) -> Column:
    def count(of: str) -> Column:
        return F.length(F.regexp_replace(value, f"[^{of}]", ""))

    different = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0))))
    return (
        (F.length(value) >= looks["length"]) & (count("0-9") >= looks["digits"])
        & (count("A-Za-z") >= looks["letters"]) & (different >= looks["different"])
    )


def _spans(slim: DataFrame) -> DataFrame:
    """row, owner, repository, kind, start, stop, inside, hash, random: base spans and candidates in place."""
    each = slim.select("row", "owner", "repository", F.explode("found").alias("m")).select("row", "owner", "repository", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    assign, token = F.col("kind") == 0, F.col("kind") == len(KINDS) - 1
    long_enough = F.length(F.regexp_extract("value", ASSIGN, 2)) >= ASSIGN_LEAST
    placed = each.withColumn("stop", stop).where(~assign | long_enough)
    placed = placed.select(
        "row", "owner", "repository", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop",
        F.when(token, F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 32)).alias("hash"),
        F.when(token, looks_random(F.col("value"))).alias("random"),
    )
    # The base spans that start no later than a candidate are before it in this order.
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.max(F.when(~token, F.col("stop"))).over(before)
    return placed.withColumn("inside", F.coalesce(covered >= F.col("stop"), F.lit(False)))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories, named, random of every candidate."""
    flags = [F.max("inside").alias("named"), F.max("random").alias("random")]
    again = [F.max("named").alias("named"), F.max("random").alias("random")]
    held = spans.groupBy("hash", "owner", "repository").agg(*flags)
    owners = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), *again)
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), *again)


def verdict(max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> Column:
    """example, live or plain for a row of ownership."""
    shared = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    return F.when(shared, "example").when(F.col("named") | F.col("random"), "live").otherwise("plain")


def scan(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Columns of docs with n_assign, n_access, n_hex, base_spans and spans (text: kind:start:end, comma-joined).

    Places are code points, the end is exclusive. carry names the columns to keep, all by default.
    """
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    kept = [c for c in others(docs, new) if carry is None or c in carry]
    names = [f"c{i}" for i in range(len(kept))]
    whole = F.coalesce(docs[quoted(text)], F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    slim = docs.select(
        *(docs[quoted(c)].alias(n) for c, n in zip(kept, names, strict=True)),
        F.monotonically_increasing_id().alias("row"), docs[quoted(owner)].cast("string").alias("owner"),
        docs[quoted(repository)].cast("string").alias("repository"),
        F.concat(*[matches(whole, p, k) for k, p in enumerate(patterns)]).alias("found"),
    )
    slim = cut_lineage(slim, "secrets")  # texts are read once, and row numbers stay what they are
    spans = cut_lineage(_spans(slim), "secret-spans")
    token = F.col("kind") == len(KINDS) - 1
    live = ownership(spans.where(token)).where(verdict(max_owners, max_repositories) == "live").select("hash")
    owned = spans.where(token & ~F.col("inside")).join(live, "hash", "left_semi").select("row", "start", "kind", "stop")
    all_spans = spans.where(~token).select("row", "start", "kind", "stop").unionByName(owned)
    per = all_spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < len(KINDS) - 1)

    def number(kind: str) -> Column:
        found = F.filter("s", lambda x: x["kind"] == KINDS.index(kind))
        return F.coalesce(F.size(found), F.lit(0)).cast("long").alias(f"n_{kind}")

    per = per.select(
        F.col("row").alias("r"), *[number(k) for k in KINDS[:-1]], _written(base).alias("base_spans"), _written(F.col("s")).alias("spans")
    )
    out = slim.select(*names, "row").join(per, F.col("row") == F.col("r"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in new[:3]]
    return out.select(*names, *zero, *[F.coalesce(c, F.lit("")).alias(c) for c in new[3:]]).toDF(*kept, *new)


def _written(spans: Column) -> Column:
    """Sorted spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )
