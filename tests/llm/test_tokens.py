import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packsight.llm import repair, tokens
from packsight.llm.repair import Shard, compress, expand, pack


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_file())


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END]


ODD = [
    None, "", " ", "A plain text, it's fine.", "two  spaces\tand\nlines", "ΑΣ ΣΑΣ 日本語 Grüße ÀÉ×÷ ½²", "don't I'LL they've ''s 's", "<|endoftext|> x<|startoftext|>y",
    "a_b ___ 12ab $$$ %%% x&&& *", "é İ ﬁ  nbsp em", "🙂👍🏽 ok", "x" * 5000, "word " * 3000,
]


def test_ids_are_those_of_whole_texts(tokenizer):
    flat, counts = tokens.Encoder(tokens.vocabulary_file())(pa.array(ODD, pa.string()))
    for text, got in zip(ODD, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == encoded(tokenizer, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    flat, counts = tokens._encoder(tokens.vocabulary_file())(pa.array(texts, pa.string()))
    t = Tokenizer.from_file(tokens.vocabulary_file())
    assert [g.tolist() for g in np.split(flat, np.cumsum(counts)[:-1])] == [encoded(t, x) for x in texts]


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.Encoder(tokens.vocabulary_file())
    for text in ("one two three four", "five one two", "three three"):
        assert e(pa.array([text]))[0].tolist() == encoded(tokenizer, text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=120), max_size=6), st.sampled_from([6, 70_000]))
def test_repair_round_trip(docs, first):
    arrays = [np.array(d, dtype=np.int64) for d in docs]
    shard = Shard(pack(list(range(len(docs))), arrays, first))
    assert shard.ids().tolist() == [x for d in docs for x in d]
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d


def test_repair_compresses_and_reads_at_random():
    rng = np.random.default_rng(0)
    phrases = [rng.integers(0, 5000, rng.integers(3, 9)) for _ in range(300)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 300, rng.integers(0, 200))] or [np.zeros(0, np.int64)]) for _ in range(400)]
    grammar = compress(np.concatenate(docs), 5000)
    assert len(grammar.symbols) < 0.5 * sum(map(len, docs)) and len(grammar.left)
    assert (expand(grammar.symbols, 5000, grammar.left, grammar.right, grammar.expansion()) == np.concatenate(docs)).all()
    shard = Shard(pack(list(range(400)), docs, 5000))
    for i in rng.integers(0, 400, 50).tolist():
        assert (shard.document(i) == docs[i]).all()


def test_rules_only_name_earlier_symbols_and_long_runs_pair_up():
    grammar = compress(np.zeros(1001, dtype=np.int64), 1)
    number = np.arange(len(grammar.left)) + 1
    assert (grammar.left < number).all() and (grammar.right < number).all() and len(grammar.symbols) < 40


@pytest.mark.parametrize("length", [3000, 3001])
def test_no_frequent_pair_is_left_in_long_repeats(length):
    passage = np.random.default_rng(1).permutation(5000)[:length]
    grammar = compress(np.tile(passage, 400), 5000)
    _, counts = np.unique(grammar.symbols[:-1] << 32 | grammar.symbols[1:], return_counts=True)
    assert counts.max(initial=0) < repair.LEAST and grammar.expansion().max() > 1 << 10
    assert (expand(grammar.symbols, 5000, grammar.left, grammar.right, grammar.expansion()) == np.tile(passage, 400)).all()


def test_damaged_shards_are_refused():
    blob = bytearray(pack([1], [np.arange(50)], 100))
    blob[-1] ^= 1
    with pytest.raises(ValueError, match="whole"):
        Shard(bytes(blob))


def test_table_against_brute_force(spark, tokenizer, monkeypatch):
    rows = [(i * 3 % 47, t) for i, t in enumerate(ODD * 4) if i < 47]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("part", F.lit(1))
    start = 0
    got = {r.doc_id: r for r in tokens.token_table(df.repartition(5)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in sorted(rows):
        ids = np.array(encoded(tokenizer, text), dtype="<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_repeats_null_ids_and_empty_tables(spark, tokenizer):
    rows = [(None, "b"), (2, "x"), (2, "x"), (2, "y z"), (1, None), (None, "a")]
    got = tokens.token_table(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 2, 2]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert tokens.token_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_hold_the_ids(spark, tokenizer, tmp_path):
    df = spark.createDataFrame([(i, f"some words {i} " * 20) for i in range(30)], "doc_id long, text string")
    tokens.write_tokens(df, str(tmp_path / "t"))
    for r in tokens.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect():
        assert list(r.ids) == encoded(tokenizer, f"some words {r.doc_id} " * 20)
