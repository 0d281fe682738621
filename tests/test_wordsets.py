"""Cards of a document compared in one task, in slices and on rare words, against every two of them."""

import random

import pytest

from auditgrain.operators import matching as ma

CARD = "document_id string, id long, words array<string>"


@pytest.fixture(scope="module")
def cards():
    rng = random.Random(26)
    vocabulary = [f"w{i}" for i in range(12)] + ["two\0words", "\0", "", "é"]
    make = lambda: [(rng.choice(["a", "b", "c", "d"]), i, rng.sample(vocabulary, rng.randint(0, 9))) for i in range(60)]
    odd = [("a", 90, None), (None, 91, ["w1"]), ("e", 92, ["w1", "w1", "w2"]), ("f", 93, ["w1"])]
    return make() + odd, make() + [("e", 94, ["w2", "w3"]), (None, 95, ["w1"])]


def every_pair(live, ref, bar):
    out = set()
    for d, i, x in live:
        for e, j, y in ref:
            if d is not None and d == e and x and y:
                x_, y_ = set(x), set(y)
                share = len(x_ & y_) / min(len(x_), len(y_))
                if share >= bar and x_ & y_:
                    out.add((d, j, i, share))
    return out


def test_word_pairs_are_all(spark, cards, monkeypatch):
    live, ref = cards
    frame = lambda v: spark.createDataFrame(v, CARD).repartition(3)
    got = lambda bar: sorted(map(tuple, ma.word_pairs(frame(live), frame(ref), bar).collect()))
    for bar in (0.25, 0.5, 1.0):
        assert got(bar) == sorted(every_pair(live, ref, bar))
    want = sorted(every_pair(live, ref, 0.5))
    monkeypatch.setattr(ma, "WORDS", 3)  # a document at a time
    assert got(0.5) == want
    monkeypatch.setattr(ma, "CARDS", 25)  # some documents are too large for a task
    assert got(0.5) == want
    monkeypatch.setattr(ma, "CARDS", 0)
    assert got(0.5) == want
    assert ma.word_pairs(frame(live).limit(0), frame(ref).limit(0)).count() == 0


def test_cards_in_small_batches(spark, cards):
    live, ref = cards
    frame = lambda v: spark.createDataFrame(v, CARD).coalesce(1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            assert sorted(map(tuple, ma.word_pairs(frame(live), frame(ref)).collect())) == sorted(every_pair(live, ref, 0.25))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


@pytest.mark.parametrize("query", [ma.word_pairs, ma.pair_by_words])
def test_a_card_is_shuffled_once(spark, query):
    """No row for a word: 800 cards of 20 words, of which few pairs are alike, pass as 800 rows, with their ids for the counts."""
    rows = lambda odd: spark.createDataFrame([(d, i, [f"w{d}-{(i * 7 + j * 11) % 600}" for j in range(20)]) for d in range(20) for i in range(odd, 40, 2)], "document_id int, id int, words array<string>")

    def shuffled():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    query(rows(1), rows(0)).collect()
    assert shuffled() - before < 4000


def test_references_take_the_best_free_card(spark, cards, monkeypatch):
    """In order of their ids; documents within and beyond a task's size give the same."""
    live, ref = cards
    frame = lambda v: spark.createDataFrame(v, CARD).repartition(3)
    want, used = [], set()
    for d, r, x, share in sorted(every_pair(live, ref, 0.25), key=lambda p: (p[1], -p[3], p[2])):
        if (d, "r", r) not in used and (d, "l", x) not in used:
            used |= {(d, "r", r), (d, "l", x)}
            want.append((d, r, x, share))
    for n in (ma.CARDS, 25):
        monkeypatch.setattr(ma, "CARDS", n)
        assert sorted(map(tuple, ma.pair_by_words(frame(live), frame(ref)).collect())) == sorted(want)
