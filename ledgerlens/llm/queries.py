"""The registered queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import align, contamination, fingerprint, langid, maintext, merkle, mixing, pii, secrets, simhash, substrings, tokens, urls
from ledgerlens.llm.sql import SQL  # noqa: F401
from ledgerlens.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# The rules for urls.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~held_out()))
    found = langid.identify(docs, profiles, carry=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, places and checksums of all documents, read back from the compressed files."""
    path = tokens.write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), TOKENIZER)
    return tokens.read_tokens(spark, path)


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows."""
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def is_contaminated() -> F.Column:
    """A twentieth of the words is inside benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document covered by 400-byte strings that occur elsewhere."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    found = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_copies")).alias("taken"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page's url."""
    found = urls.judge(table(spark, sf_dir, "pages"), RULES, carry=["page_id"])
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of each document."""
    found = pii.sanitise(table(spark, sf_dir, "documents"), carry=["doc_id"], with_text=False)
    base = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base.alias("base_sha256"), "spans")


def op10_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return maintext.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def tampered() -> F.Column:
    """Texts as received: those of documents with an even checksum of the id have lost their line breaks."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and the root that the tampered documents make."""
    return merkle.audit(table(spark, sf_dir, "documents"), received={"text": tampered()}, carry=["doc_id"])


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in each document."""
    return align.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES, carry=["doc_id"])


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document; a document stands for a repository, its source for the owner."""
    found = secrets.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), "spans")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_tokens, op3_contamination, op4_substrings, op5_mix,
        op6_fingerprints, op7_urls, op8_simhash, op9_pii, op10_maintext, op11_merkle, op12_align, op13_secrets,
    )
}
