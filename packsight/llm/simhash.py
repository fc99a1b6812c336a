"""Near-duplicate detection: 64-bit SimHash, linked at a Hamming distance of 2 or less by anchor points.

The anchors are the codewords of a covering code on 46 of the 64 bits: the product of two perfect binary Golay codes
[23, 12, 7] of covering radius 3. Each fingerprint has one home anchor (the nearest codeword of each half) and is
replicated to every anchor that lies within covering radius plus threshold of it: a half that holds d of the pair's
differing bits can be 3 + d away from the other's home, and the d of both halves sum to 2 at most. That makes 61
anchors on average, whatever the data. Per anchor, homes are compared with visitors.

An anchor that is home to more than ``HOT_HOMES`` distinct fingerprints (a dense cloud of near copies) is not compared
pair by pair. Fingerprints that meet there are linked through the points between them: two are within 2 bits exactly
if some point lies within 1 bit of both, so each is sent to its 65 such points and a point links its visitors, 65 at
most, as a star. No link is lost and the work stays linear in the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.llm.common import id_and_text, pieces, texts, trim
from packsight.llm.components import connected_components
from packsight.session import Scratch, ship

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: Distinct home fingerprints beyond which an anchor is compared through points between.
HOT_HOMES = 64

BITS, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes | None) -> int:
    """SimHash of the 3-word shingles of a text, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        spans = zip(begins[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # a byte can count to 255
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndromes of the 23-bit words' low 12 and high 11 bits, and per excess 0..2 the error words of each syndrome.

    Excess e holds the words of weight 3 + e (0: up to 3), grouped by syndrome as (offsets, words).
    """
    unit = []
    for i in range(BITS):
        x = 1 << i
        for k in range(i, BITS - 13, -1):
            if x >> k & 1 and k >= 11:
                x ^= GENERATOR << (k - 11)
        unit.append(x)
    syndromes = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)
    for half, first in zip(syndromes, (0, 12), strict=True):
        for i in range(len(half).bit_length() - 1):
            half[1 << i : 2 << i] = half[: 1 << i] ^ unit[first + i]
    groups = []
    for weights in (range(RADIUS + 1), [RADIUS + 1], [RADIUS + 2]):
        words = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BITS), w)], dtype=np.int64)
        of = syndromes[0][words & 0xFFF] ^ syndromes[1][words >> 12]
        order = np.argsort(of, kind="stable")
        groups.append((np.concatenate(([0], np.cumsum(np.bincount(of, minlength=1 << 11)))), words[order]))
    return syndromes, groups


def _near(rows: np.ndarray, half: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows' 23-bit words, (row, codeword) for every codeword of that excess."""
    syndromes, groups = golay()
    offsets, words = groups[excess]
    own = half[rows]
    s = syndromes[0][own & 0xFFF] ^ syndromes[1][own >> 12]
    count = offsets[s + 1] - offsets[s]
    at = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return at, own[at] ^ words[offsets[s][at] + inner]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for uint64 fingerprints; an anchor is the two 23-bit codewords packed into one long."""
    low = (fps & np.uint64((1 << BITS) - 1)).astype(np.int64)
    high = (fps >> np.uint64(BITS) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    rows, codes, homes = [], [], []
    for a in range(THRESHOLD + 1):
        row, first = _near(np.arange(len(fps)), low, a)
        for b in range(THRESHOLD + 1 - a):
            at, second = _near(row, high, b)
            rows.append(row[at])
            codes.append(first[at] << BITS | second)
            homes.append(np.full(len(at), a == b == 0))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(homes)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        fps = np.array([fingerprint(t) for t in texts(batch.column("text"))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            row, code, home = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(part[row]), pa.array(home)], ["anchor", "fp", "home"])
    trim()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long), one row per input row; a null text has no words."""
    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _homes(distinct: DataFrame) -> DataFrame:
    return distinct.mapInArrow(lambda it: (b.filter(b.column("home")) for b in _visits(it)), "anchor long, fp long, home boolean").drop("home")


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect whatever is within 2 bits, maybe over others."""
    # Spark sizes both by the file of distinct, not by their 61 rows a fingerprint, and would broadcast them
    visits = distinct.mapInArrow(_visits, "anchor long, fp long, home boolean").select("anchor", "fp")
    homes = _homes(distinct)
    count = homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    cold = homes.join(count.where(F.col("n") <= HOT_HOMES).hint("merge"), "anchor").select("anchor", F.col("fp").alias("mate"))
    hot = count.where(F.col("n") > HOT_HOMES).select("anchor", F.lit(None).cast("long").alias("mate"))
    near = F.col("mate").isNull() | ((F.col("fp") < F.col("mate")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("mate"))) <= THRESHOLD))
    met = scratch.keep(visits.join(cold.union(hot).hint("merge"), "anchor").where(near).select("fp", "mate"), "met")
    pairs = met.where("mate IS NOT NULL").select(F.col("fp").alias("u"), F.col("mate").alias("v"))
    points = F.explode(F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))"))
    crowd = met.where("mate IS NULL").select("fp").distinct().select("fp", points.alias("point"))
    stars = (
        crowd.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u != v").select("u", "v").distinct()
    )
    return pairs.union(stars)


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id), one row per input row; root is a fingerprint and tells components apart whose
    smallest doc_id is the same."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(links(distinct.select("fp"), scratch)).select(F.col("node").alias("fp"), "root")
    scratch.drop("met")  # the components are checkpointed
    # joined by sorting: Spark would take what to broadcast from file sizes, and copies are packed many times over
    member = distinct.join(roots.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = member.groupBy("root").agg(F.min("first").alias("component_id"))
    component = member.join(first.hint("merge"), "root").select("fp", "root", "component_id")
    return prints.join(component.hint("merge"), "fp").select("doc_id", "fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the components of documents linked at 2 or fewer differing bits.

    component_id is the smallest doc_id reachable. Rows come back as often as they go in; equal fingerprints always
    link, those of texts without words (null, empty, blank) too. A null doc_id is kept and never the smallest unless
    the component has no other. An empty table gives an empty result.
    """
    return _members(docs).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, with one of each component kept: the one with the smallest doc_id.

    Columns stay as they are. Repeated rows with that id count once: of a component's rows that share the id, the one
    with the smallest text (null last) stays. Rows of one id with texts of several components are each their own
    component's. Where a component has no id at all, each fingerprint in it keeps its smallest text.
    """
    names = docs.columns
    found = _members(docs)
    kept = found.where("component_id IS NOT NULL").select(F.col("component_id").alias("__keep")).distinct()
    with_id = docs.join(kept, F.col("doc_id").cast("long") == F.col("__keep"), "left_semi")
    whole = F.struct(F.col("text").isNull().alias("no"), "text", *[n for n in names if n not in ("doc_id", "text")])

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        least = rows.groupBy(*keys).agg(F.min(whole).alias("__row"))
        return least.select(*[F.col("doc_id") if n == "doc_id" else F.col(f"__row.`{n}`").alias(n) for n in names])

    reused = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    reused = reused.where("lo != hi").select(F.col("doc_id").alias("__reused"))
    if not reused.limit(1).count():
        one = first(with_id, "doc_id")
    else:
        again = F.col("doc_id").cast("long") == F.col("__reused")
        several = with_id.join(reused, again, "left_semi")
        prints = id_and_text(several).mapInArrow(_texts_with_prints, "doc_id long, text string, fp long").distinct()
        own = found.where("doc_id = component_id").select("doc_id", "fp", "root").distinct().join(prints, ["doc_id", "fp"])
        least = F.min(F.struct(F.col("text").isNull().alias("no"), "text"))["text"]
        own = own.groupBy("doc_id", "root").agg(least.alias("__text")).select(F.col("doc_id").alias("__id"), "__text")
        same = (several["doc_id"].cast("long") == own["__id"]) & several["text"].eqNullSafe(own["__text"])
        one = first(with_id.join(reused, again, "left_anti"), "doc_id").unionByName(first(several.join(own, same, "left_semi"), "doc_id", "text"))
    lone = docs.where("doc_id IS NULL")
    if not lone.limit(1).count():
        return one
    prints = id_and_text(lone).mapInArrow(_texts_with_prints, "doc_id long, text string, fp long").select("text", "fp").distinct()
    alone = found.where("component_id IS NULL").select("fp").distinct().join(prints, "fp")
    keep = alone.groupBy("fp").agg(F.min("text").alias("__text"))
    extra = lone.join(keep, lone["text"].eqNullSafe(keep["__text"]), "left_semi").dropDuplicates(["text"])
    return one.unionByName(extra.select(*names))


def _texts_with_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        fps = np.array([fingerprint(t) for t in texts(batch.column("text"))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(fps)], ["doc_id", "text", "fp"])


def query(docs: DataFrame) -> DataFrame:
    """The digest of the whole table: doc_id, fingerprint as 16 hex digits, component_id."""
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
