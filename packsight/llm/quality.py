"""Quality classifier: gradient-boosted trees over statistics of a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.llm.boosting import Trees, fit
from packsight.llm.common import held_out, id_and_text, pieces, sample_rows
from packsight.session import ship

#: Bound of the labelled sample that the trees are fitted on.
SAMPLE = 12_000
HELD_OUT = (3, 1)
THRESHOLD = 0.5
FEATURES = (
    "chars", "words", "word_length", "upper", "digit", "space", "symbol", "non_ascii", "pipe", "bang", "lines", "line_words", "short_lines",
    "stopped_lines", "distinct_words", "repeated_lines", "repeated_triples", "top_word", "long_words", "symbol_words", "caps_words", "compression", "url", "comma", "stop",
)

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_SYMBOL = b"#$%&*+<=>@\\^_`{|}~"


def statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text; all zero for a null or blank one."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(data)
    count = lambda chars: n - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = list(zip(words, words[1:], words[2:], strict=False))
    lengths = [len(x) for x in words]
    upper = count(_UPPER)
    ends = [w[-1:] for w in words]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(lengths) / len(words), upper / n, count(_DIGIT) / n, count(b" \t\n\r\v\f") / n,
        count(_SYMBOL) / n, 0.0 if data.isascii() else count(_HIGH) / n, data.count(b"|") / len(words), data.count(b"!") / len(words), len(lines) / len(words),
        float(np.log1p(len(words) / len(lines))), sum(len(x.split()) < 4 for x in lines) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / len(lines), len(counts) / len(words),
        1 - len(set(lines)) / len(lines), 1 - len(set(triples)) / len(triples) if triples else 0.0, max(counts.values()) / len(words),
        sum(x > 14 for x in lengths) / len(words), sum(e in _SYMBOL and e != b"" for e in ends) / len(words),
        sum(w.isupper() and len(w) > 1 for w in words) / len(words), len(zlib.compress(data, 1)) / n, data.count(b"://") / len(words),
        data.count(b",") / len(words), data.count(b".") / len(words),
    ]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        x = features(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, split: tuple[int, int], limit: int) -> DataFrame:
    """(doc_id, label, text) of documents whose label is known and that are not held out, at most about ``limit``.

    The labels are thinned first, by hash, to ``limit`` rows of 12 bytes: only those are broadcast. Of contradicting labels
    of one id the larger counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("label IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(*split)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return id_and_text(docs).join(F.broadcast(sample_rows(known, limit)), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Fitted on the driver, from the statistics of the sampled documents alone; None without rows of both classes."""
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", HELD_OUT, sample).mapInArrow(_features, "label int, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    y = rows.column("label").to_numpy().astype(np.float64)
    x = np.array(rows.column("x").to_pylist())
    order = np.lexsort(np.vstack((x.T, y)))  # the fit must not depend on the order of rows
    return fit(x[order], y[order]) if 0 < y.mean() < 1 else None


def score_quality(docs: DataFrame, labels: DataFrame, model: Trees | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    A null or blank text has the statistics of an empty one. Without labels of both classes the score is 0.5. Repeated
    rows and null ids pass through; labels, lang, source and ids are no inputs of a score.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model or learn(docs, labels))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = features(batch.column("text").to_pylist())
            score = held.value.score(x) if held.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
