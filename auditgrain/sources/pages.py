"""Pages, captures and plain texts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordering import collapse_runs, keep_ends

_CHROME = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "nav", "footer", "header", "aside", "form", "noscript"))
_BLOCK = r"(?is)(<(?:h[1-6]|p|li|figcaption|caption|tr|title)\b[^>]*>.*?</(?:h[1-6]|p|li|figcaption|caption|tr|title)\s*>)"


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))


def page_blocks(pages: DataFrame, unescape: bool = True) -> DataFrame:
    """(page_id, block_no, kind, level, text): title, headings, paragraphs, list items, captions and table rows in order.

    Scripts, styles and page chrome (nav, header, footer, aside, form) are dropped first."""
    bare = F.regexp_replace("html", _CHROME, " ")
    raw = pages.select("page_id", F.posexplode(F.regexp_extract_all(bare, F.lit(_BLOCK), F.lit(1))).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", "^<([A-Za-z0-9]+)", 1))
    text = _plain(F.col("raw"))
    if unescape:
        text = F.trim(F.regexp_replace(tx.visible_text(F.col("raw")), r"\s+", " "))
    kind = F.when(tag == "title", "title").when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list_item").when(tag.isin("figcaption", "caption"), "caption").when(tag == "tr", "table_row").otherwise("paragraph")
    rows = raw.select("page_id", "pos", kind.alias("kind"), F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).alias("level"), text.alias("text")).where("text <> ''")
    return rows.withColumn("block_no", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).drop("pos")


def page_meta(pages: DataFrame) -> DataFrame:
    """Language, title, first heading, site name, date, canonical link and organisation of each page; null where absent."""
    got = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", p, 1), "<[^>]+>", ""), r"\s+", " ")), F.lit(""))
    meta = lambda name: got(rf'(?is)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"')
    ld = F.regexp_extract("html", r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)
    org = F.coalesce(F.get_json_object(ld, "$.publisher.name"), F.get_json_object(ld, "$.author.name"), meta("og:site_name"), tx.org_from_host(F.col("url")))
    return pages.select(
        "page_id", got(r'(?is)<html[^>]*\blang="([^"]*)"').alias("language"), F.coalesce(got(r"(?is)<title[^>]*>(.*?)</title>"), meta("og:title")).alias("title"),
        got(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), meta("og:site_name").alias("site_name"),
        F.coalesce(meta("article:published_time"), meta("date"), F.get_json_object(ld, "$.datePublished")).alias("published"),
        F.coalesce(got(r'(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"'), F.col("url")).alias("canonical"), org.alias("organisation"),
    )


def capture_history(captures: DataFrame, key: str, limit: int = 400) -> DataFrame:
    """Captures with 14-digit, unique stamps in order; runs of one digest keep their first; at most ``limit``, both ends kept."""
    good = captures.where(F.col("stamp").rlike(r"^\d{14}$")).groupBy(key, "stamp").agg(F.min("digest").alias("digest"))
    return keep_ends(collapse_runs(good, [key], [F.col("stamp")], "digest"), [key], [F.col("stamp")], limit)


def drop_thin(docs: DataFrame, min_words: int = 60, max_chars: int = 60_000) -> DataFrame:
    """Texts of at least ``min_words`` words, cut at ``max_chars`` characters."""
    return docs.where(tx.word_count(F.col("text")) >= min_words).withColumn("text", F.substring("text", 1, max_chars))


def redact_source(df: DataFrame, key: str) -> DataFrame:
    """Sizes instead of contents: characters of texts, estimated bytes of base64 documents."""
    return df.select(key, F.when(F.col("kind") == "text", F.length("content")).alias("n_chars"), F.when(F.col("kind") != "text", F.floor(F.length("content") * 3 / 4)).alias("n_bytes"))


def repeated_lines(docs: DataFrame, group: str, share: float = 0.5) -> DataFrame:
    """(group, k, n_docs): lines, digits masked, that stand in ``share`` of a group's documents (two of three at most, else three at least)."""
    keys = docs.select(group, "doc_id", F.explode(F.split("text", "\n")).alias("line")).select(group, "doc_id", tx.mask_digits(F.col("line")).alias("k")).where("k <> ''")
    counts = keys.distinct().groupBy(group, "k").agg(F.count(F.lit(1)).alias("n_docs"))
    totals = docs.groupBy(group).agg(F.count_distinct("doc_id").alias("total"))
    least = F.when(F.col("total") <= 3, 2).otherwise(F.greatest(F.lit(3), F.ceil(F.lit(share) * F.col("total"))))
    return counts.join(totals, group).where(F.col("n_docs") >= least).select(group, "k", "n_docs")


def drop_repeated_lines(docs: DataFrame, group: str, share: float = 0.5) -> DataFrame:
    """docs with those lines taken out of ``text``: an anti-join of the lines on (group, line), then each text put together again."""
    drop = repeated_lines(docs, group, share).select(group, "k")
    lines = docs.select(group, "doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("k", tx.mask_digits(F.col("line")))
    kept = lines.join(drop, [group, "k"], "left_anti").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n").alias("__kept"))
    return docs.join(kept, "doc_id", "left").withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce("__kept", F.lit("")))).drop("__kept")
