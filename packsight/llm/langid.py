"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter per language, stored side by side: a slot holds one bit for every language, so an n-gram's ``HASHES``
slots, and-ed, give the set of all languages that contain it in one lookup. A text's n-grams are counted per language
bit; the share that language l would get from false positives alone is fill(l) ^ HASHES and is taken off. The language
with the largest corrected share is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.llm.common import held_out, id_and_text, pieces, sample_rows
from packsight.session import ship

#: Bytes of an n-gram; texts are lower-cased, and what is no letter counts as one space.
N = 5
#: Slots of the filter: its size is fixed, 8 bytes a slot for each 64 languages, whatever it was learned from.
SLOTS_LOG2 = 20
HASHES = 3
#: Bound of the labelled sample that the filter is learned from.
SAMPLE = 8_000
#: A language contains an n-gram if this many of its sampled documents do ...
LEAST_DOCS = 3
#: ... and if its share of documents with it is this large against the language with the largest share.
RATIO = 0.4
#: Corrected shares that sum to less than this are weak evidence: the score falls with them.
FLOOR = 0.25
#: The pipeline keeps a document whose score is at least this.
MIN_SCORE = 0.1
#: ... or that is too short to tell: fewer letters' bytes than this.
EVIDENCE = 40
UNKNOWN = "und"
HELD_OUT = (4, 2)

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "


def grams(joined: bytes) -> np.ndarray:
    """The N bytes at every place, as one number."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    out = raw[: len(raw) - N + 1].astype(np.uint64)
    for j in range(1, N):
        out = out << np.uint64(8) | raw[j : len(raw) - N + 1 + j]
    return out


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    return [(gram * odd >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64) for odd in _ODD[:HASHES]]


@dataclass
class Filter:
    """slices: (words of 64 languages, slots) uint64."""

    languages: list[str]
    slices: np.ndarray
    common: int = 0

    def __post_init__(self) -> None:
        fill = [float((self.slices[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(self.languages))]
        self.wrong = np.array(fill) ** HASHES

    def shares(self, docs: list[bytes]) -> np.ndarray:
        """(document, language): the corrected share of n-grams that the language contains."""
        out = np.zeros((len(docs), len(self.languages)))
        joined = b"".join(docs)
        if len(joined) < N or not self.languages:
            return out
        ends = np.cumsum([len(d) for d in docs])
        begins = ends - [len(d) for d in docs]
        last = np.maximum(begins, ends - N + 1)
        count = np.maximum(1, last - begins)
        slots = _slots(grams(joined))
        for word in range(len(self.slices)):
            mask = self.slices[word][slots[0]]
            for s in slots[1:]:
                mask &= self.slices[word][s]
            for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                hits = np.concatenate(([0], np.cumsum(mask >> np.uint64(i % 64) & np.uint64(1), dtype=np.uint32)))
                top = len(hits) - 1
                share = (hits[np.minimum(last, top)].astype(np.int64) - hits[np.minimum(begins, top)].astype(np.int64)) / count
                out[:, i] = np.clip((share - self.wrong[i]) / max(1e-9, 1 - self.wrong[i]), 0, 1)
        return out

    def predict(self, values: list[str | None]) -> tuple[list[str], np.ndarray]:
        worded = [v is not None and any(map(str.isalpha, v)) for v in values]
        shares = self.shares([folded(v) if w else b"" for v, w in zip(values, worded, strict=True)])
        if not self.languages:
            return [UNKNOWN] * len(values), np.zeros(len(values))
        best = np.where(shares.max(axis=1) > 0, shares.argmax(axis=1), self.common)
        score = shares.max(axis=1) / np.maximum(shares.sum(axis=1), FLOOR)
        names = [self.languages[i] if w else UNKNOWN for i, w in zip(best.tolist(), worded, strict=True)]
        return names, np.where(worded, score, 0.0)


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, documents with it), summed per chunk."""
    for batch in pieces(batches, limit=2 << 20):
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            data = folded(text)
            if len(data) >= N:
                by.setdefault(lang, []).append(np.unique(grams(data)))
        for lang, found in by.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _inserts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.concatenate(_slots(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)))
        index = np.tile(batch.column("index").to_numpy(zero_copy_only=False), HASHES).astype(np.int64)
        mask = (np.uint64(1) << (index % 64).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((index // 64).astype(np.int32)), pa.array(slots), pa.array(mask)], ["word", "slot", "mask"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """Learn from text and lang of the documents that are not held out, at most about ``sample`` of them.

    The driver gets the number of sampled documents per language and the filter's slots, both bounded by parameters.
    """
    ship(docs.sparkSession)
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = sample_rows(labelled.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(*HELD_OUT)), sample)
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    slices = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOTS_LOG2), dtype=np.uint64)
    if not languages:
        return Filter(languages, slices)
    lookup = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, F.struct(F.lit(i).alias("i"), F.lit(float(sizes[lang])).alias("size")))])
    counted = labelled.select("text", "lang").mapInArrow(_document_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    rated = counted.withColumn("at", lookup[F.col("lang")]).select("gram", "n", F.col("at.i").alias("index"), (F.col("n") / F.col("at.size")).alias("rate"))
    group = rated.groupBy("gram").agg(F.collect_list(F.struct("rate", "n", "index")).alias("of"), F.max("rate").alias("top"))
    kept = group.select("gram", "top", F.explode("of").alias("x")).where((F.col("x.n") >= LEAST_DOCS) & (F.col("x.rate") >= RATIO * F.col("top")))
    rows = kept.select("gram", F.col("x.index").alias("index")).mapInArrow(_inserts, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    word, slot, mask = (rows.column(c).to_numpy() for c in ("word", "slot", "mask"))
    slices[word, slot] = mask.view(np.uint64)
    return Filter(languages, slices, max(range(len(languages)), key=lambda i: sizes[languages[i]]))


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=2 << 20):
            names, score = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row; the filter is learned from ``docs`` if none is given.

    und, with score 0: the text is null or has no letter. A text with letters but no known n-gram gets the commonest
    learned language with score 0. Without any labelled row all is und. Repeated rows and null ids pass through.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model or learn(docs))
    ship(spark)
    found = id_and_text(docs).mapInArrow(_predict(held), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(*HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """The documents, all columns, whose language is known: und goes, and so do texts of ``EVIDENCE`` letters or more that score
    under ``MIN_SCORE``: they are in none of the learned languages."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model or learn(docs))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=2 << 20):
            names, score = held.value.predict(batch.column("text").to_pylist())
            short = [len(folded(t or "")) < EVIDENCE for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array((np.array(names, dtype=object) != UNKNOWN) & ((score >= MIN_SCORE) | np.array(short))))

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(run, typed.schema)
