"""The five stages against plain loops over the same rows."""

import itertools

import corpus_pipeline as cp
from auditgrain.llm import decontaminate, toxicity
from auditgrain.llm.queries import fold
from test_operators import brute_components


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), fold(5) != 0)
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    rows = {i: t for i, t in rows.items() if i not in bad}
    seen = set()
    for i in sorted(rows):
        lines, gone = rows[i].split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        rows[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    comp = brute_components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if comp[i][1] == i}
    left = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    held = {r.doc_id for r in decontaminate.contamination(left, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {i for (i, t), b in itertools.product(rows.items(), bench) if len(b.split()) >= 12 and b in t}
    assert whole <= held
    want = set(rows) - held
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert set(got) == want
    assert all(r.n_tokens == len(r.token_ids) for r in got.values())


def test_stages_return_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
