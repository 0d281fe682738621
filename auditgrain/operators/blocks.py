"""Blocks of a page (document_id, block_no, kind, level, text): prominence, sections, paragraphs and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .segments import running


def _by():
    return Window.partitionBy("document_id").orderBy("block_no")


def demote_headings(blocks: DataFrame, max_words: int = 15) -> DataFrame:
    """Headings over ``max_words`` words become paragraphs; levels are kept within 1 to 6."""
    long_ = (F.col("kind") == "heading") & (tx.word_count(F.col("text")) > max_words)
    return blocks.withColumn("kind", F.when(long_, "paragraph").otherwise(F.col("kind"))).withColumn("level", F.when(F.col("kind") == "heading", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))))


# fixed values: how prominent the blocks of a container are
CONTAINER_PROMINENCE = {"cautionary_note": 0.3, "footnote": 0.3, "promo": 0.5, "quote": 0.7}


def assign_prominence(blocks: DataFrame) -> DataFrame:
    """Blocks in a container (a column ``container``, where there is one) have its prominence; of the others the first
    paragraph after the title 1.0, captions 0.4, the rest 0.6; titles and headings none."""
    held = F.col("container") if "container" in blocks.columns else F.lit(None).cast("string")
    own = F.coalesce(*(F.when(held == k, F.lit(v)) for k, v in CONTAINER_PROMINENCE.items()))
    titled = F.max((F.col("kind") == "title").cast("int")).over(_by().rowsBetween(Window.unboundedPreceding, -1))
    cand = (F.col("kind") == "paragraph") & held.isNull() & (F.coalesce(titled, F.lit(0)) == 1)
    nth = F.sum(cand.cast("int")).over(_by())
    marked = blocks.withColumn("__c", cand).withColumn("__n", nth)
    value = F.when(F.col("kind").isin("title", "heading"), F.lit(None)).when(held.isNotNull(), F.coalesce(own, F.lit(0.6))).when(F.col("__c") & (F.col("__n") == 1), 1.0).when(F.col("kind") == "caption", 0.4).otherwise(0.6)
    return marked.withColumn("prominence", value).drop("__c", "__n")


def _next_heading(blocks: DataFrame) -> DataFrame:
    """Headings with ``end_no``: the next title or heading of the same or a higher level."""
    h = blocks.where("kind in ('heading', 'title')").withColumn("__l", F.when(F.col("kind") == "title", 0).otherwise(F.coalesce("level", F.lit(1))))
    by = Window.partitionBy("document_id").orderBy("block_no")
    out = h
    for lv in range(7):  # levels are seven, so seven running minima replace a join
        out = out.withColumn(f"__n{lv}", F.min(F.when(F.col("__l") <= lv, F.col("block_no"))).over(by.rowsBetween(1, Window.unboundedFollowing)))
    pick = F.coalesce(*(F.when(F.col("__l") == lv, F.col(f"__n{lv}")) for lv in range(7)))
    return out.withColumn("end_no", pick).drop(*(f"__n{lv}" for lv in range(7)))


def drop_empty_headings(blocks: DataFrame) -> DataFrame:
    """Without headings that no block but headings follows before the next one of the same or a higher level."""
    later = F.min(F.when(~F.col("kind").isin("heading", "title"), F.col("block_no"))).over(_by().rowsBetween(1, Window.unboundedFollowing))
    ends = _next_heading(blocks).where("kind = 'heading'").select("document_id", "block_no", "end_no")
    marked = blocks.withColumn("__c", later).join(ends, ["document_id", "block_no"], "left")
    empty = (F.col("kind") == "heading") & (F.col("__c").isNull() | (F.col("end_no").isNotNull() & (F.col("__c") > F.col("end_no"))))
    return marked.where(~empty).drop("__c", "end_no")


def section_containers(blocks: DataFrame) -> DataFrame:
    """blocks with ``container``: footnote or cautionary under such a heading, until the next of the same or a higher level."""
    heads = _next_heading(blocks).withColumn("class", F.when(F.col("kind") == "heading", tx.heading_class(F.col("text"))))
    h = heads.where("class is not null").select("document_id", F.col("block_no").alias("h_no"), "end_no", "class")
    hit = blocks.select("document_id", "block_no").join(h, "document_id").where("block_no >= h_no and (end_no is null or block_no < end_no)")
    return blocks.join(hit.groupBy("document_id", "block_no").agg(F.max_by("class", "h_no").alias("container")), ["document_id", "block_no"], "left")


def group_paragraphs(blocks: DataFrame) -> DataFrame:
    """blocks with ``label`` P1, P2..: list items join the item before, or a paragraph that ends in a colon."""
    prev_kind, prev_text = F.lag("kind").over(_by()), F.lag("text").over(_by())
    joined = (F.col("kind") == "list_item") & ((prev_kind == "list_item") | ((prev_kind == "paragraph") & prev_text.endswith(":")))
    body = F.col("kind").isin("paragraph", "list_item", "table_row")
    fresh = body & ~F.coalesce(joined, F.lit(False))
    marked = blocks.withColumn("__b", body).withColumn("__n", F.sum(fresh.cast("int")).over(_by()))
    return marked.withColumn("label", F.when(F.col("__b"), F.concat(F.lit("P"), F.col("__n").cast("string")))).drop("__b", "__n")


def assemble_text(blocks: DataFrame, sep: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """(texts, regions): the blocks of each document joined, and each one's place in the text."""
    placed = running(blocks, ["document_id"], ["block_no"], {"start": ("sum", F.length("text") + len(sep))})
    regions = placed.withColumn("end", F.col("start") + F.length("text"))
    texts = blocks.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), sep).alias("text"))
    return texts, regions


def unique_labels(blocks: DataFrame, label: str = "text") -> DataFrame:
    """Second and later repeats of a label get (2), (3).."""
    n = F.row_number().over(Window.partitionBy("document_id", label).orderBy("block_no"))
    return blocks.withColumn("__n", n).withColumn("unique", F.when(F.col("__n") > 1, F.concat(label, F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))).otherwise(F.col(label))).drop("__n")


def quote_attribution(blocks: DataFrame, max_lines: int = 3, max_words: int = 8) -> DataFrame:
    """Up to three short one-line paragraphs right after a quote become captions."""
    last_quote = F.last(F.when(F.col("kind") == "quote", F.col("block_no")), ignorenulls=True).over(_by())
    short = (F.col("kind") == "paragraph") & (tx.word_count(F.col("text")) <= max_words)
    marked = blocks.withColumn("__q", last_quote).withColumn("__s", short)
    bad = F.max((~F.col("__s") & (F.col("block_no") > F.col("__q"))).cast("int")).over(Window.partitionBy("document_id", "__q").orderBy("block_no"))
    hit = F.col("__q").isNotNull() & F.col("__s") & (F.col("block_no") - F.col("__q") <= max_lines) & (F.coalesce(bad, F.lit(0)) == 0)
    return marked.withColumn("kind", F.when(hit, "caption").otherwise(F.col("kind"))).drop("__q", "__s")


def attention_share(blocks: DataFrame) -> DataFrame:
    """Each block kind's share of the document's words, weighted by prominence."""
    w = tx.word_count(F.col("text")) * F.col("prominence")
    per = blocks.groupBy("document_id", "kind").agg(F.sum(w).alias("w"))
    return per.withColumn("share", F.try_divide("w", F.sum("w").over(Window.partitionBy("document_id"))))


def region_counts(regions: DataFrame, key: str = "document_id") -> DataFrame:
    return regions.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))


def to_marked_text(blocks: DataFrame) -> DataFrame:
    """(document_id, text) with line markers: # for titles, ## and on for headings, - for list items."""
    mark = F.when(F.col("kind") == "title", "# ").when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1)) + 1), F.lit(" "))).when(F.col("kind") == "list_item", "- ").otherwise("")
    rows = blocks.select("document_id", "block_no", F.concat(mark, "text").alias("line"))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def layout_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines (document_id, line_no, start, end) with the kind of the region over each, by priority; a range join by bin."""
    from .matching import binned

    order = F.when(F.col("kind") == "list_item", 0).when(F.col("kind") == "title", 1).when(F.col("kind") == "heading", 2).when(F.col("kind") == "caption", 3).otherwise(9)
    x = binned(lines.where("end > start")).withColumnsRenamed({"start": "s", "end": "e"})
    r = binned(regions.select("document_id", "kind", "start", "end"))
    hit = x.join(r, ["document_id", "__bin"]).where("start < e and s < end").groupBy("document_id", "line_no").agg(F.min_by("kind", F.struct(order, "kind")).alias("kind"))
    return lines.where("end > start").join(hit, ["document_id", "line_no"], "left")
