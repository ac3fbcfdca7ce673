"""The registered queries of the text operators, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes, collocations, decontam, embedding_dedup, langid, line_dedup, mixing, oracles, pii, quality, secrets, simhash, toxicity, warc
from .common import held_out, read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of secrets a kind and the places of all spans; a null text holds none."""
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))

    def n(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in secrets.BASE_KINDS], F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("secrets")).alias("spans"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents with their cell, inclusion probability and weight."""
    return mixing.sample_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language its text is in, `und` for a text that is null or has no letter."""
    found = langid.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links, its component and whether it is the component's first; unsound vectors link with nothing."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conditional revisit of the pages' capture log, resolved."""
    found = warc.resolve_revisits(warc.captures_of(read(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select("record_id", "canonical", "response_id", "verdict", fields.alias("headers"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark passage found: document, item, place in the text and word edits."""
    found = decontam.passages(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.item_id", "p.start", "p.end", "p.distance")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with both views' calibrated scores and the combined one; null texts and metadata are scored, too."""
    found = quality.score(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "quality.score_text", "quality.score_meta", "quality.score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, the decision at 0.3 and the labelled documents nearest to it; null texts are scored, too."""
    found = toxicity.score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    near = F.array_join(F.transform("toxicity.neighbours", lambda x: x["doc_id"].cast("string")), ",")
    score = F.col("toxicity.score")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), near.alias("neighbours"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of matches a kind and the places of all spans, disclosing terms last; a null text holds none."""
    found = pii.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"] != "term")
    every = F.size(base).cast("bigint").alias("n_base")
    return found.select("doc_id", *[n(k) for k in pii.PATTERNS], F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"), n("term"), every)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its group; a null text has fingerprint zero."""
    near = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def op11_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numbered change with its fate and the client's city and cents after it; rows without valid_at vanish."""
    log = read(spark, sf_dir, "client_changes").select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
    return changes.applied_changes(log)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest 2,000 collocations of each language; null texts have no words, a null language is `und`."""
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines, those it loses to earlier documents, and the hash of what stays; a null text is one empty line."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.index_of(docs).dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_id": op3_language_id,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_sequenced_changes": op11_sequenced_changes,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": oracles.secret_scan(),
    "op4_embedding_dedup": oracles.EMBEDDING_LINKS,
    "op5_warc_revisits": oracles.warc_revisits(),
    "op12_phrase_collocations": oracles.COLLOCATIONS,
    "op13_line_dedup": oracles.LINE_DEDUP,
}
