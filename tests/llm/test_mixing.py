import hashlib
import math

import pytest
from pyspark.sql import functions as F

from packsight.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def make(spark, n=3000):
    source = lambda i: "src0" if i % 3 == 0 else f"src{i % 7}"
    return docs(spark, [(i, f"text {i} " * (1 + i % 5), "en", source(i), 0) for i in range(n)])


def test_shares_follow_the_targets(spark):
    out = mixing.mix_sources(make(spark), {"src0": 1.0, "src1": 4.0}, 1.0)
    size = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(size.values())
    weights = {s: {"src1": 4.0}.get(s, 1.0) for s in size}
    for s, n in size.items():
        assert n / total == pytest.approx(weights[s] / sum(weights.values()), abs=0.04)


def test_counts_invert_the_distribution(spark):
    """Each document's copies against a Poisson quantile summed term by term."""
    df = make(spark, 400)
    rate = {r.source: r.rate for r in mixing.rates(df, {"src1": 600.0}, 1.0, 30.0).collect()}
    assert max(rate.values()) > mixing.PART  # several draws are summed there, too
    got = {(r.doc_id): r["count"] for r in mixing.mix_sources(df, {"src1": 600.0}, 1.0, 30.0).groupBy("doc_id").count().collect()}
    for r in df.collect():
        key = hashlib.md5(f"{mixing.SEED}|{r.doc_id}|{r.text}".encode()).hexdigest()
        parts = max(1, math.ceil(rate[r.source] / mixing.PART))
        mean, want = rate[r.source] / parts, 0
        for j in range(parts):
            u = (int(hashlib.md5(f"{key}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k, p = 0, math.exp(-mean)
            c = p
            while c < u:
                k += 1
                p *= mean / k
                c += p
            want += k
        assert got.get(r.doc_id, 0) == want


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    df = make(spark, 300)
    want = sorted(map(tuple, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix_sources(df).collect())) == want


def test_global_order_and_copies(spark):
    rows = mixing.mix_sources(make(spark, 500), {}, 1.0, 2.0).collect()
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    ids = [r.doc_id for r in rows]
    assert ids != sorted(ids) and {r.copy for r in rows} >= {1, 2}


def test_nulls_ties_empty_and_clashing_columns(spark):
    rows = [(1, None, None, None, None), (None, "abc", "en", None, 3), (2, "", "en", "a", 0), (3, "xyz", "en", "b", 3), (3, "xyz", "en", "b", 3)]
    out = mixing.mix_sources(docs(spark, rows), {}, 1.0, 50.0)
    found = {(r.doc_id, r.text, r["count"]) for r in out.groupBy("doc_id", "text").count().collect()}
    assert all(n % 2 == 0 for i, _, n in found if i == 3) and not any(i == 2 for i, *_ in found) and any(i is None for i, *_ in found)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    clash = make(spark, 50).withColumn("copy", F.lit("x")).withColumn("shuffle_key", F.lit(0)).withColumn("rate", F.lit(1)).withColumn("size", F.lit(2))
    out = mixing.mix_sources(clash)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "rate", "size", "copy", "shuffle_key"] and dict(out.dtypes)["copy"] == "int"


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_sources(make(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_very_long_texts(spark):
    rows = [(i, f"{i} " * 400_000, "en", f"src{i % 2}", 0) for i in range(4)]
    out = mixing.mix_sources(docs(spark, rows), {}, 1.0, 3.0).select("doc_id", F.length("text").alias("n")).collect()
    assert out and {r.n for r in out} == {800_000}
