"""Line dedup by overlapping windows of consecutive lines; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _window_hashes(lines: Column, window: int) -> Column:
    """Two 64-bit hashes of every ``window`` consecutive lines; none for fewer lines."""

    def at(i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(window)]
        return F.struct(F.xxhash64(*part).alias("a"), F.xxhash64(F.lit("second"), *part).alias("b"))

    return F.when(F.size(lines) >= window, F.transform(F.sequence(F.lit(0), F.size(lines) - window), at))


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """``docs`` with later occurrences of repeated line windows removed from ``text``, and n_lines, n_removed.

    A window is ``window`` consecutive lines (split at line feeds).  Where the same window occurs again,
    in any document, all but the first occurrence by (doc_id, line number) are covered; covered windows
    that overlap or touch are merged and their lines removed.  Texts of fewer lines stay as they are, a
    null text stays null, a text that loses all lines becomes empty.  Rows of one doc_id with the same
    text are the same occurrence; with different texts they are ordered by a hash of the text.  Every
    column is returned; columns named n_lines or n_removed are replaced.

    Windows are shuffled as hashes with their place, the first place of each repeated window is a plain
    aggregate (combined before the shuffle), and only places of later occurrences go back to the documents."""
    base = docs.drop("n_lines", "n_removed").withColumn("__t", F.xxhash64("text"))
    occ = (
        base.where(F.col("text").isNotNull())
        .select("doc_id", "__t", F.split("text", "\n", -1).alias("lines"))
        .select("doc_id", "__t", F.posexplode(_window_hashes(F.col("lines"), window)).alias("pos", "w"))
        .select("doc_id", "__t", "pos", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    )
    place = F.struct("doc_id", "__t", "pos")
    # written first: a window that a third of all texts hold is then a hot key of a join of two plain exchanges, which Spark splits
    first = written(occ.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("a", "b", "first"), "windows")
    later = occ.join(first, ["a", "b"]).where(place > F.col("first"))
    p = F.col("p")
    starts = F.filter(p, lambda x, i: (i == 0) | (x - F.get(p, i - 1) > window))
    ends = F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) - x > window)), lambda x: x + window)
    runs = later.groupBy("doc_id", "__t").agg(F.array_sort(F.collect_set("pos")).alias("p")).select(
        F.col("doc_id").alias("__d"), F.col("__t").alias("__u"), starts.alias("__starts"), ends.alias("__ends")
    )
    lines, s, e = F.col("__lines"), F.col("__starts"), F.col("__ends")

    def gap(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1))
        end = F.when(k == F.size(s), F.size(lines)).otherwise(F.get(s, k))
        return F.slice(lines, begin + 1, end - begin)

    removed = F.aggregate(F.zip_with(s, e, lambda x, y: y - x), F.lit(0), lambda a, x: a + x)
    joined = base.join(runs, base["doc_id"].eqNullSafe(runs["__d"]) & (base["__t"] == runs["__u"]), "left")
    out = joined.withColumn("__lines", F.split("text", "\n", -1)).withColumn(
        "__kept", F.when(s.isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), gap)), "\n"))
    )
    kept = [F.col("__kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns if c != "__t"]
    return out.select(
        *[base[c] if c == "doc_id" else x for c, x in zip([c for c in base.columns if c != "__t"], kept, strict=True)],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).alias("n_lines"),
        F.when(s.isNull(), 0).otherwise(removed).alias("n_removed"),
    )


ORACLE_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS s
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM l WHERE len(ls) >= 3)),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + x AS p FROM later, (SELECT unnest([0, 1, 2]) AS x)),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS p FROM l),
kept AS (SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.p) FILTER (WHERE gone.p IS NULL) AS t,
                count(*) AS n, count(gone.p) AS r
         FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.p = lines.p GROUP BY lines.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(coalesce(r, 0) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
