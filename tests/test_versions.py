"""Sentences of two versions paired in order, against a quadratic search, and the kinds of change."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditgrain.functions import text as tx
from auditgrain.functions.text import STOP_WORDS
from auditgrain.operators import mining as mi
from auditgrain.plans import registry

ROW = "document_id long, sentence_no long, text string"


def words(text):
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in STOP_WORDS and not re.search("[0-9]", w)}


def weight(a, b, bar=0.5):
    x, y = words(a), words(b)
    both = len(x & y)
    return both * 2.0 * both / (len(x) + len(y)) if x and y and both / min(len(x), len(y)) >= bar else None


def heaviest(old, new):
    """Weight of the best set of pairs that keeps both orders."""
    best = [[0.0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, a in enumerate(old):
        for j, b in enumerate(new):
            w = weight(a, b)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (w or 0.0))
    return best[-1][-1]


def test_alignment_is_the_heaviest_in_order(spark):
    rng = random.Random(4)
    vocabulary = [f"word{'abcdefghij'[i]}" for i in range(10)]
    old, new = {}, {}
    for d in range(25):
        make = lambda: [" ".join(rng.choices(vocabulary, k=rng.randint(1, 5))) + f" {rng.randint(1, 99)}" for _ in range(rng.randint(0, 8))]  # noqa: E731, B023
        old[d], new[d] = make(), make()
    frame = lambda v: spark.createDataFrame([(d, i, t) for d, ts in v.items() for i, t in enumerate(ts)], ROW)
    got = {}
    for r in mi.align_sentences(frame(old), frame(new)).collect():
        got.setdefault(r.document_id, []).append(r)
    for d in old:
        rows = got.get(d, [])
        assert sorted(r.old_no for r in rows if r.old_no is not None) == list(range(len(old[d])))
        assert sorted(r.new_no for r in rows if r.new_no is not None) == list(range(len(new[d])))
        equal = {(r.old_no, r.new_no) for r in rows if r.old is not None and r.old == r.new}
        chain = sorted((r.old_no, r.new_no) for r in rows if r.old_no is not None and r.new_no is not None and (r.old_no, r.new_no) not in equal)
        assert all(a[1] < b[1] for a, b in zip(chain, chain[1:], strict=False))
        rest = [[t for i, t in enumerate(v[d]) if i not in {e[k] for e in equal}] for k, v in enumerate((old, new))]
        assert abs(sum(weight(old[d][i], new[d][j]) for i, j in chain) - heaviest(*rest)) < 1e-9


def test_kinds_of_change(spark):
    old = ["We will cut emissions of our plants by 40% by 2030.", "Packaging will be recycled by 2025 in every market.", "Suppliers report their energy use.", "Water use fell in dry regions.", "Same words here.", "Same words here.", "We at it."]
    new = ["We will cut emissions of our plants by 30% by 2030.", "Packaging will be recycled by 2028 in every market.", "Water use fell in most dry regions.", "same  words here.", "Forests are protected now."]
    rows = lambda v: spark.createDataFrame([(1, i, t) for i, t in enumerate(v)] + [(2, 0, "Only in one."), (3, 0, None)], ROW)
    got = {(r.document_id, r.old_no, r.new_no): r.change for r in mi.version_changes(rows(old).where("document_id <> 2"), rows(new)).collect()}
    assert got[1, 0, 0] == "weakened" and got[1, 1, 1] == "delayed" and got[1, 2, None] == "dropped" and got[1, 3, 2] == "restated" and got[1, 4, 3] == "unchanged"
    assert got[1, 5, None] == "dropped" and got[1, 6, None] == "dropped" and got[1, None, 4] == "added" and got[2, None, 0] == "added"
    assert mi.version_changes(rows(old).limit(0), rows(new).limit(0)).count() == 0


def test_alignment_writes_little(spark):
    """One exchange, of the sentences, and nothing written between: no list of words or candidates goes to disk."""
    rows = lambda v: spark.createDataFrame(v, ROW).repartition(3)
    old = [(d, i, f"alpha{'abcde'[i % 5]} beta gamma{'abc'[d % 3]} {i}") for d in range(6) for i in range(9)] + [(None, 0, "beta gamma"), (7, 0, None)]
    out = mi.align_sentences(rows(old), rows([(d, i, t and t.replace("beta", "delta")) for d, i, t in old]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan and "Scan ExistingRDD[document_id" in plan
    assert len(out.where("document_id < 7 and old_no is not null and new_no is not null").collect()) == 54
    assert out.where("document_id is null").count() == 2


def test_versions_are_made_once(spark, sf):
    """Both versions come from one scan, and their sentences pass one exchange."""
    plan = registry.QUERIES["m7_version_changes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_batches_read_texts_as_columns_do(spark):
    rng = random.Random(7)
    parts = ["The", "water", "eau", "élan", "Σας", "ΟΔΟΣ", "İle", "\u212aelvin", "abc1", "1abc", "of", "at", "net-zero", "“quoted”", "it’s", "–", "—", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000", "中文", "A", ".", "", "😀"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, "", " ", "\x00a  b"]
    low = F.lower("text")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    got = rows.select(low.alias("low"), tx.squash(F.col("text")).alias("squashed"), F.filter(tx.content_words(F.col("text")), lambda w: ~w.rlike("[0-9]")).alias("words"), mi.letter_words(F.col("text")).alias("letters")).collect()
    assert mi._squashed(pa.array([r.low for r in got], pa.string())).to_pylist() == [r.squashed for r in got]
    assert all(r.words == r.letters for r in got)
    for cut in (0, 7):
        size, code = mi._letter_words(pa.array([r.low for r in got], pa.string())[cut:])
        assert size.tolist() == [len(r.words or []) for r in got[cut:]]
        words_of = np.split(code, np.cumsum(size)[:-1])
        name = {}
        for r, codes in zip(got[cut:], words_of, strict=True):
            for w in codes:
                name.setdefault(int(w), set(r.words)).intersection_update(r.words)
        assert all(name[int(w)] for codes in words_of for w in codes) and len(name) == len({w for r in got[cut:] for w in r.words or []})


def test_documents_beyond_a_batch(spark):
    """Documents that begin and end within batches, or go on over several, give what they give in one."""
    rng = random.Random(5)
    make = lambda d: [(d, i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=3)) + f" {i % 4}") for i in range(rng.randint(0, 9))]
    old, new = ([r for d in [*range(12), None] for r in make(d)] for _ in range(2))
    frame = lambda v: spark.createDataFrame(v, ROW).coalesce(1)
    took = lambda: sorted(map(repr, mi.version_changes(frame(old), frame(new)).collect()))
    want, kept = took(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 5):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            assert took() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert all("old_no=None" in r or "new_no=None" in r for r in want if "document_id=None" in r)
