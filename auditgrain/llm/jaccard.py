"""N-gram Jaccard self-join by T-occurrence search with DivideSkip.

Two texts link when ``100 * |A & B| >= 75 * |A | B|`` over their sets of distinct five-word
shingles.  The plan:

1.  In the order of their hashes, take the first ``n - T + l`` of a document's ``n`` shingles
    (``T = ceil(0.75 n)``, ``l`` a share of ``n``).  Two linking documents have at least the lesser
    ``l`` in common there, so documents with fewer shared ones are done, and most never send
    the rest of their shingles anywhere.
2.  For the others, every shingle's document frequency.  A document needs ``T`` shared shingles.  Sorted from the rarest list to the longest, the last ``T - 1`` lists are the long ones;
    a partner must stand in at least one of the remaining short lists.
3.  Each short list elects its most central member; documents with the same elected member
    share a *cell*, so every linking pair meets in a cell.  Cells are cut into blocks.
4.  Inside a block, T-occurrence search: a query's short lists are merged and counted, its long
    lists are probed by binary search for the candidates that can still reach the overlap.
    Partners that are already connected are skipped, so a group of copies costs no pairs.
5.  Cells of more than one block are compared across blocks in a second pass, only between
    documents that the first pass left in different components.

Documents with equal shingle sets are one class (they link with each other); classes, not
copies, are searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import grouped, list_array, lower_ascii, mix, slices, spread, text_buffer, windows, word_hashes, word_spans
from .components import connected_components
from .scratch import checkpointed, partitions, written

BLOCK = 2048
#: Up to so many ids (16 MB) a list of documents is broadcast; a longer one is joined by shuffling.
BROADCAST_IDS = 2_000_000


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _least(n: np.ndarray) -> np.ndarray:
    """The ``l`` of step 1: how many shingles two linking documents have in common among the first."""
    return np.maximum(15 * n // 100, 1)


def _runs(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row in rising order, their rows, and their number per row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, row, np.bincount(row, minlength=rows)


def shingle_sets(docs: DataFrame, size: int = 5, lead: Callable[[np.ndarray], np.ndarray] | None = None, shift: int = 0) -> DataFrame:
    """(doc_id, n_shingles, sig_a, sig_b, shingles array<long>): distinct word shingles of each whole text.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space.  Fewer words than
    ``size`` give one shingle; null, empty and blank texts give none.  ``lead`` maps set sizes to how
    many of the least hashes are listed (all without it); ``shift`` drops low bits of those listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offsets = text_buffer(part.column("text"))
            raw = lower_ascii(raw)
            starts, ends, first = word_spans(raw, offsets)
            h, row, _ = windows(word_hashes(raw, starts, ends), first, size)
            h, row, counts = _runs(h, row, part.num_rows)
            sums = [np.zeros(part.num_rows, dtype=np.uint64) for _ in range(2)]
            begin = np.cumsum(counts) - counts
            some = np.flatnonzero(counts)
            if len(some):
                sums[0][some] = np.add.reduceat(mix(h), begin[some])
                sums[1][some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin[some])
            listed = counts if lead is None else np.minimum(lead(counts), counts)
            out = spread(h, begin, listed) >> np.uint64(shift)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), list_array(pa.array(out.view(np.int64)), listed)],
                names=["doc_id", "n_shingles", "sig_a", "sig_b", "shingles"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long, shingles array<long>")


def _links(query: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, ids: np.ndarray, pool: np.ndarray, pool_bounds: np.ndarray, pool_sizes: np.ndarray, pool_ids: np.ndarray, comp: dict, percent: int, mu: float = 0.01) -> list[tuple[int, int]]:
    """T-occurrence search of each query set in the pool, skipping what is already connected.

    ``query`` and ``pool`` hold the sets one after the other, cut by their bounds.  Returns links that
    join two components of the block, never all pairs of a group."""
    parent = comp

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # Inverted lists: postings of one shingle stand together, by pool row.
    owner = np.repeat(np.arange(len(pool_ids)), np.diff(pool_bounds))
    order = np.argsort(pool, kind="stable")
    keys, lists = pool[order], owner[order]
    out = []
    roots = np.array([root(int(x)) for x in pool_ids])
    for q in range(len(ids)):
        mine = root(int(ids[q]))
        n = int(sizes[q])
        fits = (100 * pool_sizes >= percent * n) & (percent * pool_sizes <= 100 * n) & (roots != mine)
        if not fits.any():
            continue
        terms = query[bounds[q] : bounds[q + 1]]
        lo, hi = np.searchsorted(keys, terms), np.searchsorted(keys, terms, side="right")
        length = hi - lo
        need = -(-percent * n // 100)
        # DivideSkip: this many of the longest lists are probed, the others merged.
        longest = int(min(need - 1, need / (mu * np.log2(max(int(length.max(initial=1)), 2)) + 1)))
        by = np.argsort(length, kind="stable")
        short, long_ = by[: max(len(terms) - longest, 0)], by[max(len(terms) - longest, 0) :]
        runs = [lists[lo[t] : hi[t]] for t in short if length[t]]
        if not runs:
            continue
        count = np.bincount(np.concatenate(runs), minlength=len(pool_ids))
        cand = np.flatnonzero((count >= max(need - longest, 1)) & fits)
        if not len(cand):
            continue
        have = count[cand]
        for t in long_:
            if length[t]:
                run = lists[lo[t] : hi[t]]
                at = np.minimum(np.searchsorted(run, cand), len(run) - 1)
                have = have + (run[at] == cand)
        union = n + pool_sizes[cand] - have
        for c in cand[100 * have >= percent * union]:
            a, b = root(int(ids[q])), root(int(pool_ids[c]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                roots[roots == max(a, b)] = min(a, b)
                out.append((int(ids[q]), int(pool_ids[c])))
    return out


def _sets(table: pa.Table):
    col = table.column("shared").combine_chunks()
    values, offsets = np.asarray(col.flatten()), np.asarray(col.offsets)
    return values, offsets - offsets[0], np.asarray(table.column("n_shingles")), np.asarray(table.column("doc_id"))


_EDGES = "a long, b long"


def _pack(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _search_blocks(percent: int):
    """Within one block of one cell: every document against the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, ["cell", "block"]):
            if block.num_rows < 2:
                continue
            s = _sets(block)
            pairs = _links(*s, *s, {int(x): int(x) for x in s[3]}, percent)
            if pairs:
                yield _pack(pairs)

    return run


def _search_across(percent: int):
    """Outlying documents (side 0) of a cell against one block of it (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["cell", "block", "outliers"]):
            side = np.asarray(group.column("side"))
            q, p = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
            if not q.num_rows or not p.num_rows:
                continue
            comp: dict[int, int] = {}
            for t in (p, q):
                for d, c in zip(t.column("doc_id").to_pylist(), t.column("component").to_pylist(), strict=True):
                    comp[d] = c
                    comp.setdefault(c, c)
            pairs = _links(*_sets(q), *_sets(p), comp, percent)
            if pairs:
                yield _pack(pairs)

    return run


def _ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with a list of ids; it is broadcast only when it is counted to be short."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def jaccard_links(docs: DataFrame, percent: int = 75, size: int = 5, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of the texts in ``docs`` (doc_id, text).

    classes: doc_id, n_shingles, rep (least doc_id with an equal set; null for an empty set).
    links: a, b between class representatives, enough of them to connect every linking pair."""
    n_parts = partitions(docs.sparkSession)
    # One pass over the texts gives sizes, signatures and the least hashes for step 1.  As many bits as leave
    # one chance hit in 256 suffice to tell which ones are shared; a chance hit keeps a document for step 2, it never links one.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = max(0, 64 - 8 - max(int(total) // 2, 1).bit_length())
    heads = written(shingle_sets(docs, size, lambda n: n - _need(n, percent) + _least(n), shift), "heads")
    key = ["n_shingles", "sig_a", "sig_b"]
    # Only sets that occur again, written first: Spark can split a hot one in a join of two plain exchanges.
    same = checkpointed(heads.where("n_shingles > 0").groupBy(key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    classes = checkpointed(heads.drop("shingles").join(same, key, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).alias("rep")))

    # Step 1, for one document of each class.
    lead = _ids(heads, classes.where("doc_id <> rep").select("doc_id").distinct(), "left_anti").select("doc_id", "n_shingles", F.explode("shingles").alias("h"))
    met = written(lead.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h"), "met")
    hits = lead.join(met, "h").groupBy("doc_id", "n_shingles").agg(F.count(F.lit(1)).alias("hits"))
    least = F.expr(f"greatest(1L, (15 * (({percent} * n_shingles + 99) div 100)) div 100)")
    open_ = checkpointed(hits.where(F.col("hits") >= least).select("doc_id").distinct())

    sets = written(shingle_sets(_ids(docs, open_, "left_semi"), size).select("doc_id", "n_shingles", "shingles"), "sets")
    if not classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["doc_id"])  # repeated rows of a doc_id are one document
    rows = sets.select("doc_id", "n_shingles", F.explode("shingles").alias("h"))
    freq = written(rows.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "frequencies")
    shared = rows.join(freq, "h").select("doc_id", "n_shingles", "h", "df")
    per_doc = (
        shared.groupBy("doc_id", "n_shingles").agg(F.collect_list(F.struct("df", "h")).alias("s"))
        .withColumn("need", F.expr(f"cast(({percent} * n_shingles + 99) div 100 as int)"))
        .where("size(s) >= need")
        .select("doc_id", "n_shingles", "need", F.transform(F.array_sort("s"), lambda x: x["h"]).alias("shared"))
    )
    per_doc = checkpointed(per_doc)
    short = per_doc.select(
        "doc_id", (F.size("shared") / F.col("n_shingles")).alias("central"),
        F.explode(F.expr("slice(shared, 1, size(shared) - need + 1)")).alias("h"),
    )
    lists = short.groupBy("h").agg(F.min_by("doc_id", F.struct(-F.col("central"), "doc_id")).alias("cell"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = checkpointed(short.select("doc_id", "h").join(lists.select("h", "cell"), "h").select("cell", "doc_id").distinct())
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    placed = members.join(sizes, "cell").select(
        "cell", "doc_id", "m", F.expr(f"cast(pmod(xxhash64(doc_id), (m + {block - 1}) div {block}) as int)").alias("block")
    )
    loaded = placed.join(per_doc.select("doc_id", "n_shingles", "shared"), "doc_id")
    inside = (
        loaded.select("cell", "block", "doc_id", "n_shingles", "shared")
        .repartition(n_parts, "cell", "block").sortWithinPartitions("cell", "block", "doc_id")
        .mapInArrow(_search_blocks(percent), _EDGES)
    )
    links = checkpointed(inside)
    wide = placed.where(f"m > {block}")
    if wide.isEmpty():
        return classes, links
    comp = connected_components(links)
    labelled = checkpointed(
        wide.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("cell", "doc_id", "block", F.coalesce("component", "doc_id").alias("component"))
    )
    main = (
        labelled.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("k"))
        .groupBy("cell").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    )
    marked = labelled.join(main, "cell")
    outside = marked.where("component <> main")
    per_cell = outside.groupBy("cell").agg(F.count(F.lit(1)).alias("u"))
    grid = marked.select("cell", "block").distinct().join(per_cell, "cell").withColumn("outlier_blocks", F.expr(f"(u + {block - 1}) div {block}"))
    queries = (
        outside.join(per_cell, "cell")
        .withColumn("outliers", F.expr(f"cast(pmod(xxhash64(doc_id, 7), (u + {block - 1}) div {block}) as int)"))
        .join(grid.select("cell", F.col("block").alias("to")), "cell")
        .select("cell", F.col("to").alias("block"), "outliers", F.lit(0).alias("side"), "doc_id", "component")
    )
    pool = (
        marked.join(per_cell, "cell")
        .select("cell", "block", F.explode(F.expr(f"sequence(0, cast((u + {block - 1}) div {block} as int) - 1)")).alias("outliers"), F.lit(1).alias("side"), "doc_id", "component")
    )
    across = (
        queries.unionByName(pool).join(per_doc.select("doc_id", "n_shingles", "shared"), "doc_id")
        .repartition(n_parts, "cell", "block", "outliers").sortWithinPartitions("cell", "block", "outliers", "doc_id")
        .select("cell", "block", "outliers", "side", "doc_id", "component", "n_shingles", "shared")
        .mapInArrow(_search_across(percent), _EDGES)
    )
    return classes, checkpointed(links.unionByName(across))


def jaccard_components(docs: DataFrame, percent: int = 75, size: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies for every row of ``docs``.

    component_id is the least doc_id reachable by links, itself included; n_copies is the number of other
    rows with an equal shingle set (links to different sets are not counted: partners that are already connected
    are never compared).  Null, empty and blank texts have no shingles and stand alone.
    Repeated doc_ids keep one row each; columns other than doc_id and text are not read."""
    classes, links = jaccard_links(docs, percent, size, block)
    comp = connected_components(links)
    copies = classes.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    # only classes of several rows or with links, written first, so that a hot class can be split
    known = checkpointed(copies.join(comp.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or component is not null"))
    return (
        classes.join(known, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"))
    )


def keep_representatives(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """``docs`` with one document (the least doc_id) of each group of near copies; columns as given.

    Rows without a doc_id stay: they cannot stand for another or be told from one."""
    gone = jaccard_components(docs.where("doc_id is not null"), percent, size).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


#: DuckDB SQL of jaccard_components' rows on documents, by all pairs that share a shingle: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS k FROM s GROUP BY 1), r AS (SELECT k, min(doc_id) AS rep, count(*) AS copies FROM c GROUP BY 1), sr AS (SELECT s.* FROM s JOIN r ON r.rep = s.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sr a JOIN sr b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)), ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT rep AS doc_id, rep AS m FROM r UNION SELECT ways.y, reach.m FROM reach JOIN ways ON ways.x = reach.doc_id),
comp AS (SELECT doc_id, min(m) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(comp.m, d.doc_id) AS BIGINT) AS component_id, CAST(coalesce(r.copies, 1) - 1 AS BIGINT) AS n_copies
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN r ON r.k = c.k LEFT JOIN comp ON comp.doc_id = r.rep
"""
