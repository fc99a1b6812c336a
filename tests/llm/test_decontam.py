import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packsight.llm import decontam
from packsight.llm.decontam import Items, align, allowed, contaminated, drop_contaminated, find, hashed, hashed_words, words

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]


def text(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(item, edits):
    w = item.split()
    for _ in range(edits):
        op, at = rng.choice("sid"), rng.randrange(len(w))
        if op == "s":
            w[at] = "zz" + str(rng.random())[2:8]
        elif op == "i":
            w.insert(at, "yy" + str(rng.random())[2:8])
        elif len(w) > 1:
            w.pop(at)
    return " ".join(w)


def brute(item, doc):
    """The least word edits between an item and any span of a document."""
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_is_the_brute_force_one():
    for _ in range(40):
        item, region = np.array([rng.randint(1, 4) for _ in range(6)], np.uint64), np.array([[rng.randint(1, 4) for _ in range(11)]], np.uint64)
        cost, begin = align(item, region)
        assert cost.min() == brute(item.tolist(), region[0].tolist())
        stop = int(cost[0].argmin())
        assert brute(item.tolist(), region[0, begin[0, stop] : stop].tolist()) == cost.min()


@pytest.fixture(scope="module")
def corpus():
    items = [text(n) for n in (5, 8, 15, 16, 24, 25, 33, 40, 59, 80)]
    docs = []
    for k in range(240):
        item = items[k % len(items)]
        n = len(item.split())
        docs.append(f"{text(rng.randint(0, 60))} {edited(item, k % (allowed(n) + 3))}. {text(rng.randint(0, 60))}")
    return items, docs + [text(150) for _ in range(60)]


def test_recall_and_precision_against_brute_force(spark, corpus):
    items, docs = corpus
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute(words(item), words(doc)) <= allowed(len(words(item)))}
    got = contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(pairs) == len(got) and not pairs - want and len(pairs) >= 0.98 * len(want)
    for r in got:
        span = words(docs[r.doc_id])[r.start : r.start + r.n_words]
        assert brute(words(items[r.item_id]), span) == r.distance and r.similarity == pytest.approx(1 - r.distance / len(words(items[r.item_id])))


def test_exact_passages_are_always_found():
    items = [text(n) for n in range(1, 90, 3)]
    block = Items(list(range(len(items))), [hashed(words(t)) for t in items])
    for i, item in enumerate(items):
        assert i in {m[0] for m in find(block, hashed(words(f"{text(20)} {item.upper()} {text(20)}")))[0]}


@pytest.mark.parametrize("prefilter", [True, False])
def test_tables_alone_reach_the_recall_at_the_largest_distance(prefilter):
    """Candidates come from the LSH tables: with every window embedded, and with the windows that a run suggests."""
    items = [text(n) for n in (10, 15, 20, 25, 30, 40, 47, 60, 100, 150)]
    block = Items(list(range(len(items))), [hashed(words(t)) for t in items])
    found = wanted = 0
    for _ in range(3):
        for i, item in enumerate(items):
            doc = words(f"{text(15)} {edited(item, allowed(len(words(item))))} {text(15)}")
            wanted += 1
            found += i in {m[0] for m in find(block, hashed(doc), prefilter=prefilter)[0]}
    assert found >= 0.9 * wanted


def test_edits_at_one_end_of_a_long_item():
    item = text(300)
    block = Items([1], [hashed(words(item))])
    doc = words(text(60) + " " + " ".join(item.split()[60:]))
    assert [m[0] for m in find(block, hashed(doc))[0]] == [0]


def test_a_long_item_beside_many_short_ones_stays_small():
    rng_ = np.random.default_rng(0)
    long, short = rng_.integers(1, 1 << 62, 20_000).astype(np.uint64), [rng_.integers(1, 1 << 62, 40).astype(np.uint64) for _ in range(10_000)]
    block = Items(list(range(10_001)), [*short, long])
    assert block.nbytes < 100 << 20
    h = np.concatenate([short[17], long[:10_000], long[10_050:], short[9_999][:38]])
    got = {m[0]: m[3] for m in find(block, h)[0]}
    assert got == {17: 0, 10_000: 50, 9_999: 2}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aBc É×÷ªµ²½_0'\u00a0\n.", max_size=30)), min_size=1, max_size=5))
def test_words_cut_as_bytes_are_those_of_the_expression(found):
    h, count = hashed_words([None if t is None else t.encode() for t in found])
    assert count.tolist() == [len(words(t)) for t in found]
    assert h.tolist() == [x for t in found for x in hashed(words(t)).tolist()]


def test_blocks_of_a_large_benchmark_agree(spark, corpus, monkeypatch):
    items, docs = corpus
    d = spark.createDataFrame(list(enumerate(docs[:60])), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(map(tuple, contaminated(d, b).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 5000)
    assert sorted(map(tuple, contaminated(d, b).collect())) == want


def test_nulls_empties_repeats_and_extra_columns(spark):
    item = text(30)
    b = spark.createDataFrame([(1, item), (2, None), (3, "  ,"), (4, item)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    rows = [(1, f"a {item} b", "x"), (1, f"a {item} b", "x"), (None, item, "x"), (2, None, "x"), (3, "", None), (4, "word " * 5000 + item, "x"), (5, text(100), "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in contaminated(d, b).collect())
    assert got == sorted([(1, 1, 0)] * 2 + [(1, 4, 0)] * 2 + [(0, 1, 0), (0, 4, 0), (4, 1, 0), (4, 4, 0)])
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    empty = b.where("false")
    assert contaminated(d, empty).count() == 0 and drop_contaminated(d, empty).count() == len(rows) and contaminated(d.where("false"), b).count() == 0
