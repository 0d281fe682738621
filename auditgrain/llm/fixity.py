"""Merkle fixity audit of WARC archives: compare replicas by tree and descend only where they differ.

Records lie in files, one after the other.  A leaf hashes a record with its offset; the first level's nodes
hash, in order, the leaves that begin in each 64 KB of a file, every further level sixteen neighbouring offset
ranges, up to whole files; files are then dealt into ever fewer nodes up to the root.  Two archives with equal
roots are equal byte for byte; else the audit joins the children of differing nodes only, level by level, down to
the records of differing ranges: so it tells changed, missing and extra records, and those that moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import checkpointed

FAN = 16
FILE_IDS = 1024
RANGE = 1 << 16
#: Records without an id are dealt into so many files of their own.
NULL_FILES = 1 << 20


def warc_records(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """(record_id, nth, file_no, offset, length, digest) of the pages written as WARC response records.

    A file holds the pages of ``file_ids`` consecutive ids, in order; offset and length are those of
    the record in its file.  Rows with one page_id are ordered by digest and numbered (nth); pages without an id lie in
    files below 0, by a hash of their url; a null url or html counts as empty.  Other columns are not read."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )
    pid = F.col("page_id").cast("long")
    # files of ids below 0 come after those, so that no file is shared
    file_no = F.when(pid.isNull(), -1 - F.pmod(F.xxhash64(url), F.lit(NULL_FILES))).when(pid < 0, F.floor(pid / file_ids) - NULL_FILES).otherwise(F.floor(pid / file_ids)).cast("long")
    cut = pages.select(pid.alias("record_id"), file_no.alias("file_no"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"))
    before = Window.partitionBy("file_no").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy("file_no", "record_id").orderBy("digest")).cast("long")
    return cut.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("nth", F.when(F.col("record_id").isNull(), F.col("file_no") * (1 << 40)).otherwise(F.lit(0)) + nth)


def _hashed(rows: DataFrame, keys: list[str], kid: list[str]) -> DataFrame:
    """One node for each ``keys``: the hash of its children in the order of ``kid``."""
    kids = F.array_sort(F.collect_list(F.struct(*kid, "digest")))
    text = F.concat_ws("|", F.transform(kids, lambda x: F.concat_ws(":", *(x[k] for k in kid), x["digest"])))
    return rows.groupBy(*keys).agg(F.sha2(text, 256).alias("digest"))


def _leaf() -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("record_id").cast("string"), F.lit("-")), "offset", "length", "digest"), 256)


def merkle_levels(records: DataFrame, top: int, n_files: int, fan: int = FAN) -> list[DataFrame]:
    """Levels of (file_no, node, digest), the nodes of 64 KB first, up to a single root (or none for an empty archive).

    ``top`` is the largest offset and ``n_files`` the number of files that the tree is built for: equal for archives to be compared."""
    leaves = records.select("file_no", F.floor(F.col("offset") / RANGE).cast("long").alias("node"), F.col("offset").alias("at"), _leaf().alias("digest"))
    levels = [checkpointed(_hashed(leaves, ["file_no", "node"], ["at"]))]
    width = RANGE
    while width <= top:
        width *= fan
        up = levels[-1].select("file_no", F.floor(F.col("node") / fan).cast("long").alias("up"), "node", "digest")
        levels.append(checkpointed(_hashed(up, ["file_no", "up"], ["node"]).withColumnRenamed("up", "node")))
    size = n_files
    while size > 1:
        size = -(-size // fan)
        up = levels[-1].select(_bucket(size).alias("up"), "file_no", "node", "digest")
        levels.append(checkpointed(_hashed(up, ["up"], ["file_no", "node"]).select(F.col("up").alias("file_no"), F.lit(0).cast("long").alias("node"), "digest")))
    return levels


def _bucket(size: int) -> Column:
    return F.pmod(F.xxhash64("file_no"), F.lit(size)).cast("long")


def fixity_audit(primary: DataFrame, replica: DataFrame, fan: int = FAN) -> DataFrame:
    """(record_id, status, file_no, offset, length): records of ``primary`` and ``replica`` that differ.

    Both as warc_records gives them.  status is changed (other bytes), moved (the same bytes in another place), missing
    (not in the replica) or extra (only there); the place is that in the primary, or in the replica for extra ones.
    Repeated ids are told apart by nth.  Equal archives and two empty ones give no rows."""
    both = primary.select("file_no", "offset").unionByName(replica.select("file_no", "offset"))
    shape = both.agg(F.coalesce(F.max("offset"), F.lit(0)).alias("top")).first()["top"], both.select("file_no").distinct().count()
    ours, theirs = (merkle_levels(r, int(shape[0]), int(shape[1]), fan) for r in (primary, replica))
    sizes, width = [], RANGE
    while width <= shape[0]:
        width *= fan
        sizes.append(None)
    size = shape[1]
    while size > 1:
        size = -(-size // fan)
        sizes.append(size)
    key = ["file_no", "node"]
    differing = None
    for i in range(len(ours) - 1, -1, -1):
        a, b = ours[i], theirs[i]
        if differing is not None:  # only children of nodes that differ
            above = differing.select(F.col("file_no").alias("f"), F.col("node").alias("n"))
            if sizes[i] is None:
                parent = (F.col("file_no") == F.col("f")) & (F.floor(F.col("node") / fan) == F.col("n"))
            else:
                parent = (_bucket(sizes[i]) == F.col("f")) & (F.col("n") == 0)
            a, b = (x.join(above, parent, "left_semi") for x in (a, b))
        pairs = a.withColumnRenamed("digest", "x").join(b.withColumnRenamed("digest", "y"), key, "full")
        differing = checkpointed(pairs.where(~F.col("x").eqNullSafe(F.col("y"))).select(key))
    place = F.floor(F.col("offset") / RANGE).cast("long")
    a, b = (r.withColumn("node", place).join(differing, key, "left_semi").select("record_id", "nth", "file_no", "offset", "length", "digest") for r in (primary, replica))
    a, b = a.alias("a"), b.alias("b")
    same = F.col("a.record_id").eqNullSafe(F.col("b.record_id")) & (F.col("a.nth") == F.col("b.nth"))
    status = (
        F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").when(F.col("a.digest") != F.col("b.digest"), "changed")
        .when((F.col("a.offset") != F.col("b.offset")) | (F.col("a.file_no") != F.col("b.file_no")), "moved")
    )
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    return a.join(b, same, "full").select(pick("record_id"), status.alias("status"), pick("file_no"), pick("offset"), pick("length")).where("status is not null")


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with damage at places that follow from the ids: every 97th page has its first
    '<' turned into '[', every 211th is lost, and every 307th occurs once more under a new id."""
    pid = F.col("page_id")
    kept = pages.where((pid % 211 != 7) | pid.isNull())
    hurt = kept.withColumn("html", F.when(pid % 97 == 13, F.regexp_replace("html", "^([^<]*)<", "$1[")).otherwise(F.col("html")))
    again = pages.where(pid % 307 == 11).withColumn("page_id", -1000 - pid)
    return hurt.unionByName(again)


ORACLE_SQL = r"""
WITH hurt AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN regexp_replace(html, '^([^<]*)<', '\1[') ELSE html END AS html FROM pages WHERE page_id % 211 <> 7
  UNION ALL SELECT -1000 - page_id, url, html FROM pages WHERE page_id % 307 = 11),
rec AS (SELECT *, CASE WHEN record_id < 0 THEN CAST(floor(record_id / 1024.0) AS BIGINT) - 1048576 ELSE CAST(floor(record_id / 1024.0) AS BIGINT) END AS file_no, strlen(warc) AS length FROM (
  SELECT s, page_id AS record_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
   || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
   || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS warc
  FROM (SELECT 'a' AS s, page_id, url, html FROM pages UNION ALL SELECT 'b', page_id, url, html FROM hurt))),
placed AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY s, file_no ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM rec)
SELECT * FROM (SELECT coalesce(a.record_id, b.record_id) AS record_id,
    CASE WHEN b.warc IS NULL THEN 'missing' WHEN a.warc IS NULL THEN 'extra' WHEN a.warc <> b.warc THEN 'changed' WHEN a."offset" <> b."offset" THEN 'moved' END AS status,
    coalesce(a.file_no, b.file_no) AS file_no, coalesce(a."offset", b."offset") AS "offset", CAST(coalesce(a.length, b.length) AS BIGINT) AS length
  FROM (SELECT * FROM placed WHERE s = 'a') a FULL JOIN (SELECT * FROM placed WHERE s = 'b') b ON a.record_id = b.record_id) WHERE status IS NOT NULL
"""
