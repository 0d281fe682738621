"""Corpus operators against brute force, and on nulls, empty and clashing tables."""

import hashlib
import itertools
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditgrain.llm import components, decontaminate, fixity, jaccard, langid, linededup, media, pieces, pii, queries, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_lines string, pii string, score string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def odd_rows():
    """Null and empty texts, blanks, ties, copies, one long text; and columns whose names clash with outputs."""
    texts = [None, "", "   ", "a", BASE, BASE, BASE.upper(), BASE + " nineteen", "\n".join([BASE] * 5), "x" * 5000, "é😀 ▁ \t end", "\n\n\n", "  two  spaces "]
    return [(i, t, "en" if i % 2 else None, "s", None, "c", "c", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_components(spark, sf, odd, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, block=block).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("power", [10, 11, 12])
def test_long_words_of_equal_polynomials(spark, power):
    """A word and its complement whose polynomial hashes modulo 2^64 are equal for every odd base: no link, no match."""
    bits = [bin(i).count("1") % 2 for i in range(1 << power)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {(1, 1), (2, 2), (3, 1)}
    items = spark.createDataFrame([(7, " ".join([a] * 9))], "item_id long, text string")
    texts = spark.createDataFrame([(1, " ".join([b] * 9)), (2, " ".join([a] * 9))], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(texts, items).collect()} == {2}


def test_jaccard_representatives(odd, empty):
    kept = jaccard.keep_representatives(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 4 in ids and not {5, 6, 7} & ids and {0, 1, 2, 3} <= ids
    assert jaccard.jaccard_components(empty).count() == 0
    loose = odd.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    assert jaccard.keep_representatives(loose).where("doc_id is null").count() == 1
    assert {r.doc_id: r.n_copies for r in jaccard.jaccard_components(odd).collect()}[4] == 2


def test_jaccard_repeated_rows(spark):
    other = BASE.replace("one ", "zero ")
    rows = [(3, BASE), (3, BASE), (4, other), (9, "x y z"), (9, "x y z"), (None, BASE)]
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (4, 3), (9, 9), (9, 9)]


def test_components_of_a_long_chain(spark):
    n = 5000
    chain = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("a"), ((F.col("id") + 1) * 7919 % n).alias("b"))
    got = components.connected_components(chain)
    assert got.where("component <> 0").count() == 0 and got.count() == n


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [8192, 40, 2])
def test_substring_repeats(spark, sf, odd, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring.drop_repeats(docs, shard=shard).collect()}
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_substring_empty(empty):
    assert substring.drop_repeats(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 300).astype(np.uint8)
    starts, ends = np.array([0, 100, 180]), np.array([100, 180, 300])
    sa = substring.suffix_array(raw, starts, ends)
    stop = np.repeat(ends, ends - starts)
    text = [raw[i : stop[i]].tobytes() for i in sa]
    assert text == sorted(text)
    lcp = substring.common_prefixes(raw, starts, ends, sa, 1000)
    for k in range(1, len(sa)):
        a, b = text[k - 1], text[k]
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == want


def test_line_dedup(odd, empty):
    rows = {r.doc_id: r for r in linededup.dedup_lines(odd).collect()}
    assert rows[0].text is None and rows[0].n_removed == 0 and rows[0].n_lines == 0
    assert rows[8].text.split("\n") == [BASE] * 2 + [] or rows[8].n_removed > 0
    assert rows[4].text == BASE and rows[4].score == "c"
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_brute(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    seen = set()
    for r in sorted(docs.collect()):
        lines, gone = r.text.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        assert got[r.doc_id] == "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_pieces_round_trip(odd, empty):
    rows = {r.doc_id: r for r in pieces.encode(odd, read_back=True).collect()}
    for i, t, *_ in odd_rows():
        assert rows[i].decoded == (t or "")
    assert rows[0].token_ids == [] and rows[1].token_ids == [] and rows[1].score == 0
    assert pieces.encode(empty).count() == 0


def test_pieces_scan_equals_whole(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    whole = {r.doc_id: r.score for r in pieces.encode(docs).collect()}
    cut = {r.doc_id: r for r in pieces.encode(docs, giant_bytes=200, chunk_bytes=60, read_back=True).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(cut) == set(whole)
    for i, s in whole.items():
        assert cut[i].score == pytest.approx(s) and cut[i].decoded == texts[i]


def test_pieces_repeated_giants_and_no_ids(spark):
    docs = spark.createDataFrame([(None, "one two three " * 30), (7, "four five " * 40), (7, "four five " * 40), (7, "six " * 90)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.decoded) for r in pieces.encode(docs, giant_bytes=100, chunk_bytes=40, read_back=True).collect())
    assert got == sorted((r.doc_id or -1, r.text) for r in docs.collect())


def test_pieces_best_path():
    """The search against a plain dynamic programme over all splits."""
    v = pieces.load_vocabulary()
    lat = pieces.Lattice(v)
    score = {p: s for p, s, use in zip(v.pieces, v.scores, v.normal) if use}
    for text in ("hello world", "unbelievable results", "日本 is", "aaa\nbbb"):
        data = b" " + text.encode()
        best = [0.0] + [-1e18] * len(data)
        for e in range(1, len(data) + 1):
            for s in range(max(0, e - lat.reach), e):
                got = score.get(data[s:e])
                if got is None and (s == 0 or data[s] & 0xC0 != 0x80) and len(data[s:e].decode("utf-8", "ignore")) == 1 and len(data[s:e].decode("utf-8", "ignore").encode()) == e - s:
                    got = lat.unknown
                if got is not None:
                    best[e] = max(best[e], best[s] + got)
        assert lat.one(data)[1] == pytest.approx(best[-1])


def test_media(odd, empty):
    got = media.media_columns(media.store_media(odd), read_back=True)
    rows = {r.doc_id: r for r in got.collect()}
    for i, t, *_ in odd_rows():
        raw = (t or "").encode()
        padded = media.pad(raw)
        assert len(padded) % 64 == 0 and len(padded) > 0 and padded[: len(raw)] == raw
        assert rows[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[i].error is None
        assert len(rows[i].keyframes) == -(-len(padded) // 64 // 12) or rows[i].n_samples == len(padded) // 64
    assert media.store_media(empty).count() == 0


def test_media_malformed(spark):
    good = media.write_container(media.pad(b"abc" * 100))
    rows = [(1, None), (2, b""), (3, b"not a container at all"), (4, good[: len(good) // 2]), (5, good)]
    got = {r.k: r for r in media.media_columns(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert got[5].error is None and got[5].codec == "raw " and all(got[i].error for i in (1, 2, 3, 4))


def test_media_hostile():
    nested = b""
    for _ in range(3000):
        nested = media._box(b"moov", nested)
    with pytest.raises(ValueError):
        list(media.walk(nested[:-1]))
    assert media.read_tracks(nested) == []
    good = media.write_container(media.pad(b"abc" * 100))
    at = good.index(b"stsz") + 12
    with pytest.raises(ValueError):  # four thousand million samples of 64 bytes in a small file
        media.read_tracks(good[:at] + b"\xff\xff\xff\xff" + good[at + 4 :])
    rng = np.random.default_rng(5)
    for _ in range(3000):
        bad = bytearray(good)
        for i in rng.integers(0, len(bad), 4):
            bad[i] = rng.integers(0, 256)
        try:
            media.read_tracks(bytes(bad))
        except (ValueError, OverflowError, struct.error, KeyError, IndexError):
            pass


def test_media_all_tracks(spark):
    """A file whose first track is sound, with sizes packed in four bits and times in two runs."""
    pic = media.write_container(media.pad(b"z" * 640))
    moov = next((a, b) for k, a, b in media.walk(pic) if k == b"moov")
    trak = next((a - 8, b) for k, a, b in media.walk(pic, *moov) if k == b"trak")
    full = media._full
    stbl = media._box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), media._box(b"mp4a", bytes(28))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 30)),
        full(b"stz2", b"\0\0\0\x04", struct.pack(">I", 3), b"\x12\x30"), full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), full(b"stco", struct.pack(">II", 1, 8)),
    )
    sound = media._box(b"trak", media._box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 50, 0, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), media._box(b"minf", stbl)))
    tracks = media.read_tracks(media._box(b"moov", sound))
    assert [(t.kind, t.codec, t.decoded, t.sizes.tolist(), t.offsets.tolist()) for t in tracks] == [("soun", "mp4a", 50, [1, 2, 3], [8, 9, 11])]
    both = pic[: moov[0] - 8] + media._box(b"moov", sound, pic[trak[0] : trak[1]]) + pic[moov[1] :]
    row = media.media_columns(spark.createDataFrame([(1, both)], "k int, media binary")).first()
    assert row.codec == "raw " and [t.kind for t in row.tracks] == ["soun", "vide"] and row.n_samples == 10


PII_VALUES = [
    ("bob.42@mail.example.com", "email"), ("4111 1111 1111 1111", "card"), ("+1 (303) 555-0100", "phone"), ("303 555 0100", "phone"), ("123-45-6789", "ssn"), ("10.20.30.40", "ip"),
    ("2001:db8::8a2e:370:7334", "ip"), ("2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "ip"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("2024-02-29", "date"), ("31/12/1999", "date"), ("12/31/1999", "date"), ("3/4/2021", "date"),
    ("sk_live_abcdEFGH12345678", "secret"), ("x" * 44 + "@example.com", "email"), ("x" * 50 + "@example.com", "email"), ("x" * 400 + "@example.com", "email"), ("x" * 100_000 + "@example.com", "email"), ("a@" + "b." * 500 + "org", "email"),
]


@pytest.mark.parametrize("value,kind", PII_VALUES, ids=[f"{k}-{v[:24]}-{len(v)}" for v, k in PII_VALUES])
def test_pii_values(value, kind):
    text = f"see {value}, twice {value}."
    out, kinds = pii.replace_values(text, b"k")
    assert kinds == [kind, kind] and value not in out
    new = pii.pseudonym(value, kind, b"k")
    assert out == f"see {new}, twice {new}." and [k for _, _, k in pii.find_values(new)] == [kind]
    assert pii.replace_values(out, b"k", back=True)[0] == text
    assert [c.isdigit() for c in value] == [c.isdigit() for c in new] or kind == "ip"


@pytest.mark.parametrize("text", ["password=abcdefab", "password: hunter2!", "token: sk_live_abcd1234efgh", "api_key = deadbeef00", '"token": "abc123def456"', "secret=" + "Zq1" * 3000])
def test_pii_secrets(text):
    out, kinds = pii.replace_values(text, b"k")
    assert kinds == ["secret"] and out != text and pii.replace_values(out, b"k", back=True)[0] == text


@pytest.mark.parametrize("unit", ["(", "+ ", "1 ", "1.2.", "@", "::", "a:", "password", "AB12 ", "0123456789abcdef:", "1" + "-" * 1000])
def test_pii_ends_on_hostile_texts(unit):
    assert pii.replace_values(unit * (100_000 // len(unit)), b"k")[1] in ([], None)


def test_pii_long_values_depend_on_every_digit():
    one, two = (pii.pseudonym(v, "email", b"k") for v in ("a" * 99 + "b@c.example", "b" + "a" * 98 + "b@c.example"))
    assert sum(x != y for x, y in zip(one[:100], two[:100])) > 80


def test_pii_leaves_others(odd, empty):
    assert pii.find_values("4111 1111 1111 1112 and 999.1.1.1 and 2024-02-30, version 2.0.1") == []
    rows = {r.doc_id: r for r in pii.pseudonymise(odd, b"k").collect()}
    assert rows[0].text is None and rows[0].pii == [] and rows[4].text == BASE
    assert pii.pseudonymise(empty, b"k").count() == 0


def test_pii_is_a_permutation():
    assert sorted(pii.permute(i, 997, b"k", "t") for i in range(997)) == list(range(997))


def test_language(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, F.col("doc_id") % 3 != 1)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 1")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 11))
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty, F.lit(True))).collect()} == {"und"}
    mixed = spark.createDataFrame([(1, " ".join(r.text[:3000] for r in docs.where(f"lang = '{x}'").limit(1).collect()) if False else " ".join(docs.where(f"lang = '{x}'").orderBy(F.desc("n_chars")).first().text[:3000] for x in ("en", "de"))) for x in ("en",)], "doc_id long, text string")
    assert {x.lang for x in langid.predict(mixed, model).first().languages} == {"en", "de"}


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green"]
    rows = []
    for i in range(600):
        toxic = int(i % 5 == 0)
        text = " ".join(rng.choice(words, 40)) + (" grumblefoo" if toxic else "")
        rows.append((i, text, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") % 4 != 0)
    got = toxicity.score(df, model).join(df.select("doc_id", "toxic"), "doc_id").where("doc_id % 4 = 0").collect()
    assert all((r.score >= 0.5) == (r.toxic == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.drop_toxic(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") % 4 != 0).columns == ["doc_id", "text"]
    none = toxicity.fit(empty, df.select("doc_id", "toxic").limit(0), F.lit(True))
    assert toxicity.score(odd, none).count() == len(odd_rows())


def test_repeated_rows_and_ties(spark, empty):
    """Repeated doc_ids keep one row each, equal texts equal values, and a table of labels without texts fits."""
    rows = [(i % 50, f"alpha beta {'grumblefoo' if i % 5 == 0 else 'river'} gamma", int(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    got = toxicity.score(df, model).collect()
    assert len(got) == 200 and len({(r.doc_id, r.score) for r in got}) == 50 and len({r.score for r in got}) == 2
    assert toxicity.score(df, toxicity.fit(empty, df.select("doc_id", "toxic"), F.lit(True))).count() == 200
    langs = langid.fit(df.select("doc_id", "text", F.lit("en").alias("lang")), F.lit(True))
    got = langid.predict(df, langs).collect()
    assert len(got) == 200 and {(r.lang_pred, r.score) for r in got} == {("en", 1.0)}


def test_label_model_outvotes_a_wrong_label():
    """The given label is wrong in a tenth of the rows; six voters that are right in 85 of 100 outvote it."""
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    flip = lambda p: np.where(rng.random(4000) < p, y, ~y) * 2 - 1
    votes = np.stack([*(flip(0.85) for _ in range(6)), flip(0.9)], axis=1)
    post, info = toxicity.label_model(votes, anchor=6)
    assert ((post > 0.5) == y).mean() > 0.96 > ((votes[:, 6] > 0) == y).mean() and abs(info["anchor"] - 0.935) < 0.02


def test_language_set_is_estimated_again():
    """Words of two languages in equal parts, and a third that is a little like both: the set is the two, with half each."""
    p = np.array([[1, 1e-6, 0.3], [1e-6, 1, 0.3]] * 40, dtype=np.float32)
    share = langid._mixture(p, np.array([0]), np.array([80]), 60, np.array([[0.5, 0.0, 0.5]], dtype=np.float32))
    assert share[0, 1] == 0 and abs(share.sum() - 1) < 1e-5


def test_label_model_finds_the_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    flip = lambda p: np.where(rng.random(4000) < p, y, ~y) * 2 - 1
    good, bad = flip(0.95), flip(0.6)
    votes = np.stack([good, good, bad, flip(0.9), np.where(y, 1, -1)], axis=1)
    post, info = toxicity.label_model(votes, anchor=4)
    assert ((post > 0.5) == y).mean() > 0.99 and info["weights"][0] < info["weights"][2]


def test_decontamination(spark, odd, empty):
    item = "A train leaves Boston at 40 miles per hour and another leaves at 60 miles per hour so when do they meet each other on the line"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    other = item.replace("40", "35").replace("60", "70")
    wrong = item.replace("40", "35").replace("60", "35")
    docs = spark.createDataFrame([(1, f"intro words here. {item} and more"), (2, f"x {other} y"), (3, "nothing of the kind is said in this text at all"), (4, None), (5, f"z {wrong} z"), (1, f"again {item}")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert set(got) == {1, 2, 5} and got[1].kind == "verbatim" and got[2].kind == "template" and got[5].kind == "template"  # two values may become one
    shuffled = {r.doc_id for r in decontaminate.contamination(docs, bench, broadcast_windows=0).collect()}
    assert shuffled == {1, 2, 5}
    split = item.replace("miles", "40").replace("40 40", "40 miles")  # one value of the item for two of the document
    assert decontaminate.contamination(docs.where("doc_id = 2"), spark.createDataFrame([(1, split)], "item_id long, text string")).where("coverage >= 0.9").count() == 0
    assert decontaminate.contamination(odd, bench).count() == 0 and decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 4}


def test_decontamination_of_dense_items(spark):
    """Items with many numbers are found with other numbers through longer windows; a name changed outside them is not called verbatim."""
    dense = "Add 3 to 14, then take 5 from 27, double 8 and divide 90 by 6"
    short = "Add 3 to 14, take 5 from 27 and double 8"
    bench = spark.createDataFrame([(1, dense), (2, short)], "item_id long, text string")
    other = "Add 31 to 4, then take 52 from 7, double 18 and divide 9 by 16"
    rows = [(1, f"So: {other} it says"), (2, f"intro {short} outro"), (3, "intro Add 8 to 9, take 1 from 2 and double 77 outro"), (4, "Add up to the sum, then take it from there, double it and divide it by half"), (5, dense[: len(dense) - 8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 1000):
        got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contamination(docs, bench, broadcast_windows=limit).collect()}
        assert got == {(1, 1): "template", (2, 2): "verbatim", (3, 2): "template", (5, 1): "partial"}


def test_decontamination_other_lengths(spark):
    """Names and numbers of other lengths, items dense in numbers, short items, edits that shift the rest."""
    item = "On Monday a bus from Denver takes 40 minutes to reach the old bridge over the river and then 1 000 people walk home along the road to the market place of the town"
    dense = "Add 3 4 5 kg to 7 8 of 12 9 and 14"
    bench = spark.createDataFrame([(1, item), (2, dense), (3, "capital of the moon"), (4, "alone")], "item_id long, text string")
    rows = [
        (1, item.replace("Denver", "Salt Lake City").replace("1 000", "25")), (2, f"Before it: {dense}, after"), (3, "the capital of the moon is asked here"), (4, "alone"), (5, "not alone here"),
        (6, item.replace("to reach the old", "to reach the very old")), (7, item.replace("Denver", "Rome")), (8, "Chicago. " + item.replace("Denver takes", "Bath takes")), (9, "the town of the river and the road"),
    ]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "doc_id long, text string, item_id string, pos string, n_windows string, h string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(1, 1): "template", (2, 2): "verbatim", (3, 3): "verbatim", (4, 4): "verbatim", (6, 1): "partial", (7, 1): "template", (8, 1): "template"}
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_decontamination_counts_as_brute_force(spark, sf):
    """The registered query's rows against windows of all texts in plain Python, at one displacement."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_decontamination"](spark, sf).collect()}
    words = lambda t: [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in re.split(r"[\x20\x09-\x0D]+", t)) if w]
    for b in bench:
        item = " ".join(words(b.text)).lower()
        for d in docs:
            if item in " ".join(words(d.text)).lower():
                assert (d.doc_id, b.item_id) in got
    grams = lambda t: {tuple(w[i : i + 6]) for w in [words(t)] for i in range(len(w) - 5)}
    asked = set().union(*(grams(b.text) for b in bench))
    assert {i for i, _ in got} <= {d.doc_id for d in docs if grams(d.text) & asked}


def test_fixity(spark):
    rows = [(i, f"http://h{i}.example/", f"<p>page {i}</p>" * (i % 7 + 1)) for i in range(0, 5000, 3)] + [(9, "http://dup.example/", "<p>dup</p>"), (9, "http://dup.example/", "<p>dup</p>"), (None, None, None), (-1, "u", "minus"), (None, "v", "w")]
    pages = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id long, url string, html string, digest string, node string, offset string")
    hurt = pages.where("page_id is null or page_id <> 4998").withColumn("html", F.when(F.col("page_id") == 99, "<p>page 88</p>").otherwise(F.col("html")))
    hurt = hurt.where("url is null or url <> 'v'").unionByName(spark.createDataFrame([(7777, "u", "h", "", "", "")], pages.schema))
    a, b = fixity.warc_records(pages), fixity.warc_records(hurt)
    got = {(r.record_id, r.status) for r in fixity.fixity_audit(a, b).collect()}
    moved = {(r.record_id, "moved") for r in a.where("record_id > 99 and record_id < 1024").collect()}  # page 99 has another length
    assert got == {(4998, "missing"), (99, "changed"), (7777, "extra"), (None, "missing")} | moved
    assert fixity.fixity_audit(a, a).count() == 0 and fixity.fixity_audit(a, a, fan=2).count() == 0
    assert {(r.record_id, r.status) for r in fixity.fixity_audit(a, b, fan=2).collect()} == got
    none = fixity.warc_records(pages.limit(0))
    assert fixity.fixity_audit(none, none).count() == 0 and fixity.fixity_audit(none, b.limit(1)).count() == 1


def test_fixity_sees_moved_records(spark, sf):
    a = fixity.warc_records(spark.read.parquet(f"{sf}/pages.parquet"))
    later, other = a.withColumn("offset", F.col("offset") + 5000), a.withColumn("file_no", F.col("file_no") + 9)
    for b in (later, other):
        assert {r.status for r in fixity.fixity_audit(a, b).collect()} == {"moved"} and fixity.fixity_audit(a, b).count() == a.count()
    swapped = a.withColumn("offset", F.when(F.col("record_id") == 1, 0).when(F.col("record_id") == 0, F.col("length") * 0 + 1).otherwise(F.col("offset")))
    assert {(r.record_id, r.status) for r in fixity.fixity_audit(a, swapped).collect()} == {(0, "moved"), (1, "moved")}
