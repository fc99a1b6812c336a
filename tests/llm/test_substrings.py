import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packsight.llm import substrings
from packsight.llm.substrings import WINDOW, count_windows, query, remove_repeats

rng = random.Random(11)


def naive(rows):
    """(n_words, n_removed, kept) of each row by a dictionary of all windows."""
    split = [(i if i is not None else 1 << 63, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if first[tuple(w[k : k + WINDOW])] < i:
                keep[k : k + WINDOW] = [False] * WINDOW
        left = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    return out


def check(spark, rows, partitions=3):
    got = query(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(((i, *n) for (i, _), n in zip(rows, naive(rows), strict=True)), key=repr)
    return got


def words(n, size=30):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def test_shared_passages_copies_and_overlaps(spark):
    passages = [words(rng.randint(10, 70)) for _ in range(8)]
    rows = []
    for i in range(150):
        w = words(rng.randint(0, 90), 4000)
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p[rng.randint(0, 3) :]
        rows.append((i * 7 % 151, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(200 + i, rows[i % 4][1]) for i in range(30)]
    got = check(spark, rows)
    assert sum(r.n_removed > 0 for r in got) > 40


def test_small_vocabulary_and_repeats_inside_a_document(spark):
    check(spark, [(i, " ".join(words(rng.randint(0, 60), 1))) for i in range(40)] + [(99, "a " * 500), (98, "a " * 400), (97, "a b " * 100)])


def test_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON_LEAST", 4)
    passage = " ".join(words(60, 500))
    rows = [(i, f"{' '.join(words(20, 900))} {passage} {' '.join(words(20, 900))}") for i in range(120)]
    assert len(substrings.common_pieces(spark.createDataFrame(rows, "doc_id long, text string")))
    check(spark, rows)


def test_nulls_repeated_ids_unicode_and_extra_columns(spark):
    long = " ".join(words(40, 500))
    rows = [(3, long), (3, long), (3, long + " more"), (None, long), (None, long), (1, None), (2, ""), (4, "é\u00a0x " * 20), (5, "é\u00a0x " * 20), (6, long.upper())]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("mark", F.lit(1)).withColumn("gone", F.lit(1))
    assert remove_repeats(df).count() == len(rows) and remove_repeats(df.where("false")).count() == 0


def test_texts_of_one_id_whose_32_bit_hashes_are_equal(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    found = spark.range(120_000).select(F.concat(F.lit(f"{passage} x"), F.col("id").cast("string")).alias("a"), F.concat(F.lit("only a few words "), F.col("id").cast("string")).alias("b"))
    a, b = (found.select(F.col(c).alias("text"), F.hash(c).alias("h")) for c in "ab")
    twins = a.join(b.withColumnRenamed("text", "other"), "h").limit(2).collect()
    assert twins
    for key in (5, None):
        check(spark, [(1, passage)] + [(key, t) for r in twins for t in (r.text, r.other)])


def test_a_task_remembers_common_strings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON_LEAST", 4)
    passage = " ".join(words(60, 500))
    for order in (1, -1):
        rows = [(i, f"{' '.join(words(20, 900))} {passage}") for i in range(2500)][::order]
        check(spark, rows, 1)


def test_very_long_text(spark):
    check(spark, [(1, " ".join(words(60_000, 10_000))), (2, " ".join(words(3000, 10_000)))])


@pytest.mark.parametrize("collide", [False, True])
def test_windows_are_compared_by_their_words(monkeypatch, collide):
    """With a hash that says nothing all windows meet, and their words still tell them apart."""
    if collide:
        monkeypatch.setattr(substrings, "hashes", lambda distinct: np.ones(len(distinct), dtype=np.uint64))
    strings = [words(rng.randint(WINDOW, 25), 2) for _ in range(60)]
    key = np.array([rng.randint(0, 9) for _ in strings])
    which, offset = count_windows(key, np.array([len(s) for s in strings]), pa.array([w.encode() for s in strings for w in s], pa.large_binary()))
    first = {}
    for k, s in zip(key.tolist(), strings, strict=True):
        for i in range(len(s) - WINDOW + 1):
            first[tuple(s[i : i + WINDOW])] = min(first.get(tuple(s[i : i + WINDOW]), k), k)
    want = {(j, i) for j, (k, s) in enumerate(zip(key.tolist(), strings, strict=True)) for i in range(len(s) - WINDOW + 1) if first[tuple(s[i : i + WINDOW])] < k}
    assert set(zip(which.tolist(), offset.tolist(), strict=True)) == want
