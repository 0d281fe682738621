"""The registered query of every corpus operator, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fixity, hardneg, jaccard, langid, linededup, media, pieces, pii, quality, substring, toxicity, whitening

#: Key of the registered query; a real job passes a secret of its own.
PSEUDONYM_KEY = b"registered-query"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold(5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies for every document."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


ORACLE["op2_jaccard_join"] = jaccard.ORACLE_SQL


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_hash, score, and whether decoding gives the text back, for every document."""
    out = pieces.encode(_table(spark, sf_dir, "documents"), read_back=True)
    return out.select("doc_id", F.size("token_ids").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"), "score", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    out = substring.drop_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for every document."""
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op5_line_dedup"] = linededup.ORACLE_SQL


@query
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's container: stored, walked and read back."""
    got = media.media_columns(media.store_media(_table(spark, sf_dir, "documents")), read_back=True)
    span = F.when(F.size("keyframes") > 0, F.concat(F.col("keyframes")[0]["at"], F.lit("-"), F.element_at("keyframes", -1)["at"]))
    feature = F.concat_ws("|", "codec", F.col("duration_s").cast("string"), F.col("n_samples").cast("string"), F.size("keyframes").cast("string"), span, F.round("payload_mean", 3).cast("string"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_values and the kinds found, for every document."""
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", F.size("pii").alias("n_values"), F.concat_ws(",", "pii").alias("kinds"), "text")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages for every document."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(3) != 1)
    out = langid.predict(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", F.concat_ws("+", F.transform("languages", lambda x: x["lang"])).alias("languages"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_matched, coverage, kind: benchmark items held by documents."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ between the archive of the pages and a damaged replica, with their places."""
    pages = _table(spark, sf_dir, "pages")
    return fixity.fixity_audit(fixity.warc_records(pages), fixity.warc_records(fixity.damaged_copy(pages)))


ORACLE["op10_warc_fixity"] = fixity.ORACLE_SQL


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component up to 16."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE["op13_hard_negatives"] = hardneg.ORACLE_SQL
