"""Queries over all rows and whole texts that have no SQL, held against brute force."""

import random
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from auditgrain.functions import text as tx
from auditgrain.operators import calibration as cal
from auditgrain.operators import knowledge as kn
from auditgrain.operators import matching as ma
from auditgrain.operators import spans as sp
from auditgrain.plans.registry import QUERIES, queries_audit, queries_text
from auditgrain.sources import pages as pg


class Given:
    def __init__(self, **tables):
        self.__dict__.update(tables)


def squashed(s):
    return re.sub(r"\s+", " ", s.translate(str.maketrans(tx.SQUASH_FROM, tx.SQUASH_TO))).strip(" ").lower()


def test_find_quotes_whole(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    texts = {r.doc_id: squashed(r.text) for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if squashed(r.text) in t}
    assert len({i for _, i in want}) > 1 and {tuple(r) for r in sp.find_quotes(items, docs).collect()} == want


def test_find_quotes_odd(spark):
    """Short quotes, parts of words, typography, nulls, blanks, and a key column with a common name."""
    docs = [(1, "One  two three four five six seven"), (2, "x one"), (3, None), (4, ""), (5, "the \u201cold\u201d bridge \u2013 it fell"), (6, "a b a b c")]
    items = [
        (41, "two three four five six seven"), (80, "ONE"), (81, " "), (82, None), (83, "wo three four five six sev"), (84, "e tw"), (85, "n"), (86, "three four fi"), (87, "o three four five si"),
        (88, '"old" bridge - it'), (89, "b a b"), (90, "zz"), (91, "o o"), (92, "hree four"),
    ]
    want = {(d, i) for d, t in docs for i, q in items if t and q and squashed(q) and squashed(q) in squashed(t)}
    for key in ("item_id", "k", "n", "h"):
        got = sp.find_quotes(spark.createDataFrame(items, f"{key} int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), key)
        assert {tuple(r) for r in got.collect()} == want


def test_hold_out(spark):
    """Equal to the pair form on small tables; uses keep their other columns, and a ruling with several urls is out for each."""
    docs = [(d, f"http://x.example/{d}/") for d in range(6)] + [(6, None)]
    rulings = [(r, f"http://X.example/{r % 7}" if r % 3 else None) for r in range(11)] + [(0, "http://x.example/5")]
    d, r = spark.createDataFrame(docs, "doc_id int, url string"), spark.createDataFrame(rulings, "ruling_id int, adjudicated_url string")
    uses = spark.createDataFrame([(d, r, f"{d}-{r}") for d, _ in docs for r in range(11)], "doc_id int, ruling_id int, note string")
    own = {(d, r) for d, u in docs for r, a in rulings if u and a and u.rstrip("/").lower() == a.rstrip("/").lower()}
    assert sorted(tuple(x) for x in kn.hold_out(uses, d, r, "doc_id").collect()) == sorted((d, r, f"{d}-{r}") for d, _ in docs for r in range(11) if (d, r) not in own)
    assert {tuple(x) for x in kn.excluded_rulings(d, r, "doc_id").collect()} == own


def test_leave_one_out(spark):
    """Equal to pairing every case with every other entry, with null values, repeated entries, and cases without an entry."""
    store = [(i % 5, i % 2, float(i) if i % 3 else None) for i in range(11)] + [(9, None, 2.0)]
    cases = [(c, k) for c in (0, 1, 4, 7, 9) for k in (0, 1, None)]
    s, c = spark.createDataFrame(store, "entry_id int, k int, v double"), spark.createDataFrame(cases, "case_id int, k int")
    for by in ((), ("k",)):
        want = set()
        for case, k in cases:
            rest = [v for e, ek, v in store if e != case and (not by or ek == k)]
            known = [v for v in rest if v is not None]
            if rest:
                want.add((case, *((k,) if by else ()), len(rest), round(sum(known), 6) if known else None, round(sum(known) / len(known), 6) if known else None))
        got = {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in cal.leave_one_out(c, s, ["v"], by).collect()}
        assert got == want


def test_topic_coverage_long_list(spark):
    docs, topics = [(d, f"word{d} and word{d + 1}") for d in range(5)], [(f"t{k}", f"word{k}") for k in range(7)]
    got = kn.topic_coverage(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(topics, "topic string, term string")).collect()
    assert sorted((r.doc_id, r.topic, r.absent) for r in got) == sorted((d, p, w not in t.split()) for d, t in docs for p, w in topics)


def folded(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def dashed(s, pattern):
    return re.sub("^-+|-+$", "", re.sub(pattern, "-", s))


def slug(source, text):
    out = dashed(re.sub(r"[^\x00-\x7f]", "", folded("-".join(x for x in (source, text) if x))), "[^A-Za-z0-9]+").lower()
    return re.sub("[-.]+$", "", (out or "document")[:64])


def company_slug(text):
    for a, b in tx.TRANSLITERATE.items():
        text = text.replace(a, b)
    return dashed(folded(text).lower(), "[^a-z0-9]+")


def lenient_int(text):
    m = re.search("[0-9][0-9,]*", text)
    n = int(m[0].replace(",", "")) if m else None
    return n if n is None or n < 2**63 else None


def label(text):
    return re.sub("[^a-z0-9 ]+", " ", text.replace(".", "&").lower().replace("&", " and ")).strip(" ")


@pytest.mark.parametrize("name,want", [
    ("p7_slug_all", lambda r: slug(r.source, r.text)), ("p8_company_slug_all", lambda r: company_slug(r.text)),
    ("p9_lenient_int_all", lambda r: lenient_int(r.text)), ("f10_fold_label_all", lambda r: label(r.text)),
])
def test_texts_whole(spark, sf, name, want):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    odd = [(10**9 + i, x, "é1") for i, x in enumerate(("", "Ærø & Łódź. Ñ", "no number", "9" * 30, "x 1,2,, 3", "à" * 300 + "1,234"))]
    got = {r[0]: r[1] for r in QUERIES[name](spark, sf).collect()}
    assert got == {r.doc_id: want(r) for r in docs} and any(re.search(r"[^\x00-\x7f]", r.text) for r in docs)
    rows = spark.createDataFrame(odd, "doc_id long, text string, source string")
    assert {r[0]: r[1] for r in getattr(queries_text, name)(Given(documents=rows)).collect()} == {r.doc_id: want(r) for r in rows.collect()}


def half_up(v, places):
    return float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def close(v):
    return None if v is None else abs(v - half_up(v, 0)) <= max(0.05, abs(v) * 0.005)


def clamped(v):
    return None if v is None else half_up(min(1.0, max(0.0, v / 100)) + 1e-9, 2)


@pytest.mark.parametrize("name,want", [("f14_close_enough_all", close), ("p15_clamp01_all", clamped)])
def test_values_whole(spark, sf, name, want):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").collect()
    got = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
    assert sorted(got) == sorted((r.event_id, want(r.value)) for r in events)
    odd = [(i, v) for i, v in enumerate((None, 0.5, 2.5, -2.5, 0.05, 7.05, 250.5, -3.0, 99.995, 12.345, 50.0))]
    module = queries_text if name.startswith("f14") else queries_audit
    assert {tuple(r) for r in getattr(module, name)(Given(events=spark.createDataFrame(odd, "event_id int, value double"))).collect()} == {(i, want(v)) for i, v in odd}


def blocks(html):
    flags, out = re.I | re.S | re.A, []
    for m in re.finditer(pg._BLOCK.removeprefix("(?is)"), re.sub(pg._CHROME.removeprefix("(?is)"), " ", html, flags=flags), flags):
        tag = re.match("<([A-Za-z0-9]+)", m[1])[1].lower()
        x = re.sub(r"<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", " ", m[1], flags=flags)
        x = re.sub(rf"<\s*/?\s*(?:{'|'.join(tx.BLOCK_TAGS)})(?![A-Za-z0-9-])[^>]*>", "\n", x, flags=re.I | re.A)
        x = re.sub("<[^>]+>", "", x)
        x = re.sub("&(lt|gt|quot|#39|apos|nbsp|amp);", lambda e: {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": "\u00a0", "amp": "&"}[e[1]], x)
        x = re.sub(r"\s+", " ", x, flags=re.A).strip(" ")
        kind = {"title": "title", "li": "list_item", "figcaption": "caption", "caption": "caption", "tr": "table_row"}.get(tag, "heading" if re.fullmatch("h[1-6]", tag) else "paragraph")
        if x:
            out.append((len(out) + 1, kind, x))
    return out


def test_page_blocks_whole(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = [(p, *b) for p, h in pages for b in blocks(h)]
    got = [tuple(r) for r in QUERIES["s12_page_blocks_all"](spark, sf).select("page_id", "block_no", "kind", "text").collect()]
    assert sorted(got) == sorted(want)
    odd = "<title>A &amp;lt; b</title><nav><p>no</p></nav><p>R&amp;D &lt;b&gt;<br>x</p><ul><li> </li><li>&quot;q&quot; &#39;s&#39;</li></ul><tr><td>1</td><td>2 &amp; 3</td></tr>"
    got = queries_text.s12_page_blocks_all(Given(pages=spark.createDataFrame([(1, odd)], "page_id int, html string"))).collect()
    assert sorted(tuple(r) for r in got) == [(1, *b) for b in blocks(odd)] and {"R&D <b> x", "A &lt; b", "1 2 & 3"} <= {r.text for r in got}


def test_verify_quotes_in_every_capture(spark):
    pages = [("http://x.example/a", "An older page says this."), ("http://X.example/a/", "Z newer page"), ("http://x.example/b", None), ("http://x.example/c", "c")]
    ev = [(1, "http://x.example/a", "older  PAGE"), (2, "http://x.example/a/", "newer page"), (3, "http://x.example/a", "neither"), (4, "http://x.example/b", "q"), (5, None, "q"), (6, "http://x.example/d", "q"), (7, "http://x.example/c", None), (8, "http://x.example/a", "older  PAGE")]
    got = ma.verify_quotes(spark.createDataFrame(ev, "evidence_id int, url string, quote string"), spark.createDataFrame(pages, "url string, text string"))
    assert got.columns == ["evidence_id", "url", "quote", "outcome"]
    want = {1: "verified", 2: "verified", 3: "absent", 4: "unreadable", 5: "unreadable", 6: "unreadable", 7: "absent", 8: "verified"}
    assert sorted((r.evidence_id, r.outcome) for r in got.collect()) == sorted(want.items())


def test_unescape_as_the_library_does(spark):
    import html

    texts = ["R&amp;D", "&#8217;s caf&eacute; &#x41;&#65;", "&copy; &middot; &nbsp;x", "&unknown; & &; &#0; &#xD800; &#99999999;", "&amp;lt;", "plain", "&lt&gt; &hellip;&mdash;&euro;", "", None, "&#128512;"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.unescape(F.col("t")).alias("x")).collect()]
    want = [None if t is None else re.sub(r"&(#[0-9]{1,7}|#x[0-9a-fA-F]+|[a-z]+);", lambda m: html.unescape(m[0]) if m[0] not in ("&#0;", "&#xD800;") else m[0], t) for t in texts]
    assert got == want


def test_first_object(spark):
    cases = {
        'say {"a": 1} and {"a": 2}': '{"a": 1}', 'x {"t": "a } b", "n": {"k": [1]}} y }': '{"t": "a } b", "n": {"k": [1]}}', '{"q": "\\" }"} z': '{"q": "\\" }"}',
        "none": None, "open { only": None, "": None, 'it\'s "quoted" {"a": 3}': '{"a": 3}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", tx.first_object(F.col("t")).alias("x")).collect()} == cases
    assert spark.createDataFrame([("a {\"n\": 5} b {\"n\": 6}",)], "t string").select(tx.json_arrays(F.col("t"), "n int")["n"].alias("n")).first().n == 5


@pytest.mark.parametrize("line,want", [
    ("12", True), ("Page 3", True), ("3 of 10", True), ("3/10", True), ("12 | Annual report", True), ("Annual report / 12", True), ("12 | " + "x" * 41, False), ("x" * 41 + " | 12", False),
    ("of 3", False), ("chapter 3", False), ("1 of 2 of 3", False), ("a | b", False), ("", False), (" 12", False), ("page  7 of 9", True),
])
def test_page_numbers(spark, line, want):
    assert spark.createDataFrame([(line,)], "t string").select(tx.is_page_number(F.col("t")).alias("x")).first().x is want


@pytest.mark.parametrize("text,want", [
    ("Notes to the accounts", "footnote"), ("Footnotes", "footnote"), ("End notes", "footnote"), ("References", "footnote"), ("Notebook", None), ("Cautionary statements", "cautionary"),
    ("Forward-looking statements", "cautionary"), ("SAFE HARBOUR", "cautionary"), ("Legal notice", "cautionary"), ("Our legal team", None), ("Legal notes", None),
])
def test_heading_classes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.heading_class(F.col("t")).alias("x")).first().x == want


def test_terms_of_any_characters(spark):
    docs = [(1, "50 % of \u00e9t\u00e9 and CO\u2082"), (2, "nothing \u2192 here"), (3, "the end"), (4, None)]
    terms = ["%", "\u2192", "the", "\u00e9", "% of", "zz"]
    got = {tuple(r) for r in kn.mentions(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(1, "%"), (1, "\u00e9"), (1, "% of"), (2, "\u2192"), (3, "the")}


def test_labels_both_ways(spark):
    labels, aliases = ["automobile", "car", "oil & gas", "x", None], [("A", "Auto"), ("A", "automobile parts"), ("B", "racecar team"), ("C", "Oil and gas production"), ("D", "zz"), ("E", "oil")]
    docs = spark.createDataFrame(list(enumerate(labels)), "k int, label string")
    got = {r.k: (r.entry_id, r.alias) for r in kn.place_by_label(docs, spark.createDataFrame(aliases, "entry_id string, alias string"), "k").collect()}
    assert got == {0: ("A", "automobile parts"), 1: ("B", "racecar team"), 2: ("E", "oil")}


def test_repeated_lines_dropped(spark):
    rows = [(1, "g", "Head\nbody one\nPage 1"), (2, "g", "Head\nbody two\nPage 2"), (3, "g", "Head\nother\nPage 3"), (4, "h", "Head\nx"), (5, "g", None), (6, "g", "Head")]
    got = {r.doc_id: r.text for r in pg.drop_repeated_lines(spark.createDataFrame(rows, "doc_id int, source string, text string"), "source").collect()}
    assert got == {1: "body one", 2: "body two", 3: "other", 4: "Head\nx", 5: None, 6: ""}


def words_of(s):
    return {w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 2 and w not in tx.STOP_WORDS}


def test_pair_by_words(spark):
    rng = random.Random(4)
    vocabulary = ["common", *(f"word{i}" for i in range(30))]
    cards = [(d, i, " ".join(["common", *rng.sample(vocabulary, rng.randint(1, 7))])) for d in range(4) for i in range(20)]
    live, ref = [c for c in cards if c[1] % 2], [c for c in cards if c[1] % 2 == 0]
    frame = lambda rows: spark.createDataFrame(rows, "document_id int, id int, text string").select("document_id", "id", tx.content_words(F.col("text")).alias("words"))
    share = lambda a, b: len(words_of(a) & words_of(b)) / max(1, min(len(words_of(a)), len(words_of(b))))
    pairs = {(d, i, j) for d, i, a in ref for e, j, b in live if d == e and share(a, b) >= 0.25}
    assert {(r.document_id, r.ref_id, r.live_id) for r in ma.word_pairs(frame(live), frame(ref)).collect()} == pairs
    want, used = set(), set()
    for d, i, a in ref:
        free = [(-share(a, b), j) for e, j, b in live if d == e and (d, j) not in used and share(a, b) >= 0.25]
        if free:
            used.add((d, min(free)[1]))
            want.add((d, i, min(free)[1]))
    assert {(r.document_id, r.ref_id, r.live_id) for r in ma.pair_by_words(frame(live), frame(ref)).collect()} == want


def test_slugs_fold_every_character(spark):
    """Every character of Unicode as whole texts were folded; Python gets the distinct characters beyond ASCII of a text only."""
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["a".join(every[i : i + 300]) for i in range(0, len(every), 300)] + ["", "---", "É", "中", "x" * 63 + "-½y", "①ﬁ\U0001d400가 Ź", None]
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    def company(x):
        for a, b in tx.TRANSLITERATE.items():
            x = x.replace(a, b)
        return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", fold(x).lower()))

    def slug(x, limit):
        out = re.sub("^-+|-+$", "", re.sub("[^A-Za-z0-9]+", "-", re.sub(r"[^\x00-\x7f]", "", fold(x or "")))).lower()
        return re.sub("[-.]+$", "", (out or "document")[:limit])

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", tx.company_slug(F.col("t")).alias("c"), tx.slug(F.col("t")).alias("s"), tx.slug(F.col("t"), limit=10**6).alias("l")).collect():
        t = texts[r.i]
        assert r.c == (None if t is None else company(t)) and r.s == slug(t, 64) and r.l == slug(t, 10**6)
    sizes = df.select(F.length(tx.odd_characters(F.lit("é" * 1000 + "plain ü" * 1000)))).first()[0]
    assert sizes == 2
