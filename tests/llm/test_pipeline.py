import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from packsight.llm import decontam, langid, mixing, queries, simhash, tokens

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"]
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for stage, step in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = step(spark, docs, SF)
        assert docs.columns == names
        rows = docs.collect()
        ids = {r.doc_id for r in rows}
        if stage == "language_id":
            assert ids == {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))}
        elif stage == "near_dedup":
            prints = [simhash.fingerprint(r.text.encode()) for r in before]
            root = {r.doc_id: r.doc_id for r in before}
            for _ in range(5):
                for a, x in zip(before, prints, strict=True):
                    for b, y in zip(before, prints, strict=True):
                        if (x ^ y).bit_count() <= 2:
                            root[a.doc_id] = root[b.doc_id] = min(root[a.doc_id], root[b.doc_id])
            assert ids == set(root.values()) and len(rows) == len(ids)
        elif stage == "decontamination":
            items = [decontam.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {r.doc_id for r in before if any(" ".join(i) in " ".join(decontam.words(r.text)) for i in items)}
            assert held and not held & ids and len({r.doc_id for r in before} - ids - held) <= 2
        else:
            assert ids <= {r.doc_id for r in before} and set(rows) <= set(before)
        docs = spark.createDataFrame(rows, docs.schema)
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    encoder = tokens.Encoder(tokens.vocabulary_file())
    import pyarrow as pa

    flat, counts = encoder(pa.array([t for _, t in texts]))
    assert [r.doc_id for r in got] == [d for d, _ in texts] and [r.n_tokens for r in got] == counts.tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert corpus_pipeline.ORACLE_SQL is None and langid.MIN_SCORE < 1 and mixing.EPOCHS == 1.0
