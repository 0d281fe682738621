"""The automaton of terms against patterns, on many terms, and the operators on it on odd inputs."""

import random
import re

import pyarrow as pa
import pytest
from auditgrain.operators import automaton, knowledge, mining


def by_patterns(terms, texts, letters):
    word = r"[^\W_]" if letters else "[a-z0-9]"
    out = set()
    for k, term in enumerate(terms):
        p = r"\s+".join(re.escape(x) for x in term.split())
        if re.search(word, term):
            p = f"(?<!{word}){p}(?!{word})"
        for i, t in enumerate(texts):
            out |= {(i, k, m.start(), m.end(1)) for m in re.finditer(f"(?=({p}))", t, 0 if letters else re.A)}
    return out


@pytest.mark.parametrize("run", [2, 3, 256])
@pytest.mark.parametrize("letters", [False, True])
def test_scan_equals_patterns(monkeypatch, run, letters):
    monkeypatch.setattr(automaton, "RUN", run)
    rng = random.Random(run)
    signs = ["a", "b", "ab", "é", "%", "-", " ", " ", "  ", "\n", "c", "“", "1"]
    for _ in range(120):
        terms = sorted({"".join(rng.choices(signs, k=rng.randint(1, 5))).strip() for _ in range(12)} - {""})
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(8)]
        got = set(zip(*(x.tolist() for x in automaton.scan(automaton.build(terms, letters), pa.array(texts))), strict=True))
        assert got == by_patterns(terms, texts, letters)


def test_fifty_thousand_terms(spark):
    """Phrases of up to three words, many sharing words, some inside others; in one automaton and in several."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3_000)]
    terms = {" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(80_000)}
    assert len(terms) > 50_000
    texts = {i: " ".join(rng.choices(words, k=300)) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = spark.createDataFrame([(t.upper() if i % 2 else t,) for i, t in enumerate(sorted(terms))], "term string")
    want = set()
    for i, t in texts.items():
        ws = t.split()
        want |= {(i, g) for n in (1, 2, 3) for k in range(len(ws) - n + 1) if (g := " ".join(ws[k : k + n])) in terms}
    assert {(r.doc_id, r.term.lower()) for r in knowledge.mentions(docs, table).collect()} == want
    parts = automaton.term_hits(docs, table, limit=100_000).collect()
    assert {(r.doc_id, h.term.lower()) for r in parts for h in r.hits} == want
    assert all(texts[r.doc_id][h.start : h.end] == h.term.lower() for r in parts for h in r.hits)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "The  THE\nthe", "c"), (3, "of", "d"), (4, "İ 100% eco-friendly, b\tcorp", "e")], "doc_id long, text string, term string")
    terms = spark.createDataFrame([(t,) for t in ("the", "The ", "the the", "100%", "b corp", "%", " ", None, "eco")], "term string")
    got = {(r.doc_id, r.term) for r in knowledge.mentions(docs.drop("term"), terms).collect()}
    assert got == {(3, "the"), (3, "The "), (3, "the the"), (4, "100%"), (4, "%"), (4, "b corp"), (4, "eco")}
    hits = {r.doc_id: r.hits for r in automaton.term_hits(docs, spark.createDataFrame([("x",)], "term string")).collect()}
    assert set(hits) == {1, 2, 3, 4} and not any(hits.values())
    none = spark.createDataFrame([], "term string")
    assert all(not r.hits for r in automaton.term_hits(docs, none).collect())
    assert automaton.term_hits(docs.limit(0), terms).count() == 0
    topics = spark.createDataFrame([("a", "the"), ("a", "zzz"), ("b", "corp"), ("c", "nowhere")], "topic string, term string")
    rows = {(r.doc_id, r.topic): (r.seen, r.absent) for r in knowledge.topic_coverage(docs.where("doc_id <> 3 or text <> 'of'").drop("term"), topics).collect()}
    assert rows[(3, "a")] == (["the"], False) and rows[(4, "b")] == (["corp"], False) and rows[(1, "a")] == (None, True) and len(rows) == 12


def test_claims_leave_regions_out(spark):
    text = "We will cut. It was said.\nNotes\nWe will not. And it was so.\n“We are green,” they say.\nWe will grow."
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    start = text.index("We will not")
    regions = spark.createDataFrame([(1, "footnote", start, start + 12), (1, "footnote", start, start + 27), (1, "heading", 0, 500)], "document_id long, kind string, start int, end int")
    claims = lambda r: {(c.document_id, c.text) for c in mining.mine_claims(docs, regions=r).collect()}
    every = claims(None)
    assert {t for d, t in every if d == 1} == {"We will cut.", "It was said.", "We will not.", "And it was so.", "“We are green,” they say.", "We will grow."}
    assert every - claims(regions) == {(1, "We will not."), (1, "And it was so.")}
    assert every - claims(mining.quoted_regions(docs)) == {(1, "“We are green,” they say."), (2, "“We are green,” they say.")}


def test_memory_of_a_batch_is_that_of_a_slice():
    """A batch of 8 MB of texts: what the scan holds beside it at once stays small."""
    import tracemalloc

    import pyarrow as pa

    from auditgrain.operators import automaton as au

    a = au.build(["word", "of the"])
    batch = pa.RecordBatch.from_arrays([pa.array(["some word of the text " * 100] * 3800)], names=["__lower"])
    tracemalloc.start()
    hits = sum(len(au.scan(a, part.column("__lower"))[0]) for part in au._sliced(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits == 2 * 380_000 and peak < 130 << 20, peak
