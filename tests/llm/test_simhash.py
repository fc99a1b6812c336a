import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from packsight.llm import simhash
from packsight.llm.components import connected_components
from packsight.llm.simhash import anchors, drop_near_duplicates, fingerprint, golay, query, simhash_components

rng = random.Random(7)


def naive_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a B", "A b c", "é É x y\tz\x0bw", "the same " * 400, "one two three four five six"])
def test_fingerprint(text):
    assert fingerprint(text.encode() if text is not None else None) == naive_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert row.h & (1 << 64) - 1 == fingerprint(b"one two three")


def test_golay_code_is_perfect_with_radius_three():
    _, ((offsets, words), *_) = golay()
    assert len(words) == 2048 and (np.diff(offsets) == 1).all()


def test_every_pair_within_two_bits_meets_at_the_home_anchor():
    pairs = []
    for _ in range(1500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        pairs += [x, y]
    row, code, home = anchors(np.array(pairs, dtype=np.uint64))
    at = {r: c for r, c, h in zip(row.tolist(), code.tolist(), home.tolist(), strict=True) if h}
    visits = {}
    for r, c in zip(row.tolist(), code.tolist(), strict=True):
        visits.setdefault(r, set()).add(c)
    assert all(at[i] in visits[i ^ 1] for i in range(len(pairs)))


def near_copies(n, words=60):
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(words)] = f"new{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [simhash.HOT_HOMES, 1, 0])
def test_components_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    texts = near_copies(120, 40) + near_copies(60, 200) + [t for t in near_copies(5) for _ in range(8)] + [None, "", " ", "x", "X"] + [f"lone text {i} {i * i}" for i in range(60)]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in query(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()}
    fps = [naive_fingerprint(t) for t in texts]
    for i, f, c in zip(ids, fps, naive_components(ids, fps), strict=True):
        assert got[i] == (f"{f:016x}", c)
    assert len(set(naive_components(ids, fps))) < len(ids)


def test_chains_of_single_bits_are_one_component(spark):
    chain = [0]
    for b in range(60):
        chain.append(chain[-1] ^ 1 << b)
    distinct = spark.createDataFrame([(v if v < 1 << 63 else v - (1 << 64),) for v in chain], "fp long")
    from packsight.session import Scratch

    edges = simhash.links(distinct, Scratch(spark, "chain"))
    assert {r.root for r in connected_components(edges).collect()} == {0}


def planned(df):
    """What Spark plans before it has run anything."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_near_dedup_stage_broadcasts_no_visits(spark, monkeypatch):
    """Spark takes their size from a file that has one row where they have 61."""
    plans, keep = {}, simhash.Scratch.keep

    def noted(self, df, name):
        plans[name] = planned(df)
        return keep(self, df, name)

    monkeypatch.setattr(simhash.Scratch, "keep", noted)
    docs = spark.createDataFrame(list(enumerate(near_copies(30))), "doc_id long, text string")
    assert 0 < dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").count() < 30
    assert plans["met"].count("SortMergeJoin") == 2 and "Broadcast" not in plans["met"]


def test_op10_broadcasts_no_fingerprints(spark):
    docs = spark.createDataFrame(list(enumerate(near_copies(30))), "doc_id long, text string")
    found = planned(query(docs))
    assert found.count("SortMergeJoin") >= 3 and "Broadcast" not in found


def test_many_edges_that_spark_takes_for_few_are_not_broadcast(spark, monkeypatch):
    frame = type(spark.range(0))
    rounds, checkpoint = [], frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: (rounds.append(planned(self)), checkpoint(self, *a))[1])
    star = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(300_000))).alias("u"), F.lit(0).alias("v"))
    assert connected_components(star.select(F.col("u").cast("long"), F.col("v").cast("long"))).agg(F.count("node"), F.max("root")).first() == (300_001, 0)
    assert all("SortMergeJoin" in p for p in rounds[1:])


def test_connected_components_against_union_find(spark):
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert all(root[n] == r for n, r in got.items()) and {n for u, v in edges if u != v for n in (u, v)} == set(got)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nulls_repeats_empty_and_extra_columns(spark):
    rows = [(5, "same words here", 1), (5, "same words here", 2), (None, "same words here", 3), (9, None, 4), (8, "", 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_components(df).collect())
    assert got == [(-1, 5), (-1, 8), (5, 5), (5, 5), (8, 8), (9, 8)]
    assert simhash_components(df.where("false")).count() == 0
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, "same words here"), (8, "")]
    lone = spark.createDataFrame([(None, "only without id"), (None, "only without id"), (1, "b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in drop_near_duplicates(lone).collect()) == [(-1, "only without id"), (1, "b c d")]


def test_each_component_keeps_one_where_ids_are_reused(spark):
    def kept(*rows):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
        got = drop_near_duplicates(df)
        assert got.columns == df.columns
        return sorted((r.doc_id or -1, r.text or "") for r in got.collect())

    assert kept((3, "b"), (5, "z"), (5, "b")) == [(3, "b"), (5, "z")]
    assert kept((5, "b"), (5, "z"), (5, "z"), (5, "Z"), (7, "z"), (8, "lone")) == [(5, "Z"), (5, "b"), (8, "lone")]
    assert kept((5, None), (5, "z"), (6, ""), (4, "z"), (None, "z"), (None, "no id")) == [(-1, "no id"), (4, "z"), (5, "")]


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, long.upper()), (4, "short")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] and got[2][1] == 1 and got[4][1] == 4
    assert int(got[1][0], 16) == naive_fingerprint(long)
