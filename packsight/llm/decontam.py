"""Benchmark decontamination: documents that hold a benchmark item within an edit distance, found by CGK embedding.

Items and documents are sequences of lower-cased words (letters and digits). An item of n words is found in a document if
some span of it is within floor((1 - SIMILARITY) n) word edits.

1. Pieces. An item of up to ``PIECE`` words is one piece, a longer one is cut into equal pieces. Of those of an item that
   is found, at least one has no more than its share of the edits (pigeonhole), so walks stay short whatever an item is.
2. Embedding. The random walk of Chakraborty, Goldenberg and Koucky copies the word under its pointer and moves on or
   stays by a random bit of (place, word). Few edits become few differing places.
3. LSH. A table samples ``SAMPLED`` places of the walk; their words, with the table's number, are a key. All pieces are
   stored under the keys of ``WALKS`` walks with ``TABLES`` tables each, which together reach the target recall at the
   largest allowed distance. Every piece-sized window of a document asks for its keys; what is stored there is a candidate.
4. Verification. A candidate's item is aligned by dynamic programming with the words around it; only true matches are
   returned.

A window within e edits of a piece of n words shares an unedited run of ceil((n - e) / (e + 1)) words with it. Windows that
line up with no such run of any piece cannot match, and are not embedded (``prefilter``); this finds no candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsight.llm.common import hashes, id_and_text, pieces, ranges, spaced, texts
from packsight.session import ship

SIMILARITY = 0.8
WALKS, TABLES, SAMPLED = 16, 8, 3
#: Longest piece of an item.
PIECE = 48
#: Lengths by which pieces are sampled: the largest of these that is not above their own.
LENGTHS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 26, 34, 42])
#: Places of a walk that may be sampled, for each word: the pointer has then rarely passed the end.
REACH = 1.5
#: Longest run that serves as a seed; longer runs contain it.
LONGEST_SEED = 5
#: Bytes of the items' index that are broadcast at a time; a larger benchmark is taken in blocks.
BLOCK_BYTES = 96 << 20
#: Windows that are embedded at a time.
AT_ONCE = 8192
RESULT = "doc_id long, item_id long, start long, n_words long, distance int, similarity double"
SEED = 42

WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0)
#: What becomes of a byte in a text of ASCII and Latin-1: letters and digits stay, in lower case, others become spaces.
_PLAIN = np.full(256, 0x20, dtype=np.uint8)
for _low, _high, _up in ((0x30, 0x3A, 0), (0x41, 0x5B, 0x20), (0x61, 0x7B, 0), (0x80, 0xC0, 0), (0xC3, 0xC4, 0)):
    _PLAIN[_low:_high] = np.arange(_low, _high) + _up


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashed(found: list[str]) -> np.ndarray:
    coded = pa.array(found, pa.string()).dictionary_encode()
    return hashes(coded.dictionary.cast(pa.binary()))[coded.indices.to_numpy()] if len(found) else np.zeros(0, dtype=np.uint64)


def hashed_words(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of texts, and how many words each text has. Only texts with characters beyond Latin-1's
    letters go through the regular expression; the others are cut as bytes."""
    sizes = np.fromiter((len(t or b"") + 1 for t in found), dtype=np.int64, count=len(found))
    data = np.frombuffer(b"\n".join([*[t or b"" for t in found], b""]), dtype=np.uint8)
    # outside: lead bytes but C3, and C2 with the few letters and digits it has; C2 with any other is a sign
    after = np.flatnonzero(data[:-1] == 0xC2) + 1
    lettered = after[np.isin(data[after], (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE))]
    ends = np.cumsum(sizes)
    odd = np.unique(np.searchsorted(ends, np.concatenate((np.flatnonzero(data > 0xC3), lettered)), side="right"))
    keep = np.zeros(len(found), dtype=bool)
    keep[odd] = True
    if len(odd):
        found = list(found)
        for i in odd.tolist():
            found[i] = " ".join(words(found[i].decode())).encode()
        sizes = np.fromiter((len(t or b"") + 1 for t in found), dtype=np.int64, count=len(found))
        data = np.frombuffer(b"\n".join([*[t or b"" for t in found], b""]), dtype=np.uint8)
    low = _PLAIN[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    what = data[second]
    low[second[(what <= 0x9E) & (what != 0x97)]] += 0x20
    sign = np.concatenate((second[(what == 0x97) | (what == 0xB7)], np.flatnonzero(data[:-1] == 0xC2) + 1))
    low[sign], low[sign - 1] = 0x20, 0x20
    if len(odd):
        low = np.where(np.repeat(keep, sizes), data, low)
        low[np.cumsum(sizes) - 1] = 0x20
    cut, count = spaced(low, np.cumsum(sizes) - 1)
    coded = cut.dictionary_encode()
    return hashes(coded.dictionary)[coded.indices.to_numpy()] if len(cut) else np.zeros(0, dtype=np.uint64), count


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _ODD
    return x ^ x >> np.uint64(29)


def runs(h: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q neighbouring words."""
    if len(h) < q:
        return np.zeros(0, dtype=np.uint64)
    out = h[: len(h) - q + 1].copy()
    for j in range(1, q):
        out = _mix(out) + h[j : len(h) - q + 1 + j]
    return _mix(out)


def allowed(n: int) -> int:
    """Edits allowed for an item of n words."""
    return int((1 - SIMILARITY) * n + 1e-9)


def seed_length(n: int) -> int:
    e = allowed(n)
    return max(1, min(LONGEST_SEED, -(-(n - e) // (e + 1))))


def embed(h: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, walk: int, places: int) -> np.ndarray:
    """CGK walks over the words from each start on; places outputs for each. Outside of low to high there is no word."""
    at = start.copy()
    out = np.zeros((places, len(start)), dtype=np.uint64)
    top = max(0, len(h) - 1)
    for j in range(places):
        word = np.where((at >= low) & (at < high), h[np.clip(at, 0, top)], _PAD)
        out[j] = word
        at += (_mix(word + np.uint64((walk * 1_000_003 + j + 1) * 0x9E3779B1)) & np.uint64(1)).astype(np.int64)
    return out


class Lookup:
    """Places of values in a sorted array of keys; a bitmap answers for most that are not there."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int64)
        self.order = order.astype(np.int32)
        self.map = np.zeros(1 << self.BITS, dtype=bool)
        self.map[self.keys >> np.uint64(64 - self.BITS)] = True

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the value, index of the key as given) for all that are equal."""
        may = np.flatnonzero(self.map[values >> np.uint64(64 - self.BITS)])
        near = np.minimum(np.searchsorted(self.keys, values[may]), max(0, len(self.keys) - 1))
        hit = self.keys[near] == values[may] if len(self.keys) else np.zeros(len(may), dtype=bool)
        may, near = may[hit], near[hit]
        count = self.first[near + 1] - self.first[near]
        return np.repeat(may, count), self.order[ranges(self.first[near], count)]

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.first.nbytes + self.order.nbytes + self.map.nbytes


@dataclass
class Items:
    """A block of benchmark items, ready for lookup."""

    ids: list[int]
    hashes: list[np.ndarray]

    def __post_init__(self) -> None:
        self.size = np.array([len(h) for h in self.hashes], dtype=np.int64)
        self.edits = np.array([allowed(n) for n in self.size.tolist()], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.words = np.concatenate(self.hashes) if self.hashes else np.zeros(0, dtype=np.uint64)
        del self.hashes
        cuts = -(-self.size // PIECE)
        self.item = np.repeat(np.arange(len(self.size)), cuts)
        number = ranges(np.zeros(len(cuts), dtype=np.int64), cuts)
        self.offset = number * self.size[self.item] // cuts[self.item]
        size = (number + 1) * self.size[self.item] // cuts[self.item] - self.offset
        start = self.begin[self.item] + self.offset
        rng = np.random.default_rng(SEED)
        self.share = rng.random((WALKS, TABLES, SAMPLED))
        self.kinds = np.searchsorted(LENGTHS, size, side="right") - 1
        self.used = np.unique(self.kinds)
        keys = np.zeros((WALKS, TABLES, len(size)), dtype=np.uint64)
        for walk in range(WALKS):
            for part in (np.arange(a, min(len(size), a + AT_ONCE)) for a in range(0, len(size), AT_ONCE)):
                out = embed(self.words, start[part], start[part], (start + size)[part], walk, self.places(self.kinds[part].max()))
                for kind in np.unique(self.kinds[part]).tolist():
                    own = np.flatnonzero(self.kinds[part] == kind)
                    for table in range(TABLES):
                        keys[walk, table, part[own]] = self.key(out, walk, table, kind)[own]
        self.tables = Lookup(keys.ravel())
        self.seeds = {}
        lengths = np.array([seed_length(n) for n in range(PIECE + 1)])[size]
        for q in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == q)
            run, count = runs(self.words, q), size[own] - q + 1
            at = ranges(start[own], count)
            # a run and its place in a piece, once however many pieces have it there
            both = np.unique(np.array([run[at].view(np.int64), at - np.repeat(start[own], count)]), axis=1)
            self.seeds[q] = Lookup(both[0].view(np.uint64)), both[1].astype(np.int32)

    @property
    def nbytes(self) -> int:
        arrays = self.size, self.edits, self.begin, self.words, self.item, self.offset, self.kinds
        return sum(a.nbytes for a in arrays) + self.tables.nbytes + sum(x.nbytes + y.nbytes for x, y in self.seeds.values())

    def places(self, kind: int) -> int:
        return max(1, int(REACH * LENGTHS[kind]))

    def key(self, out: np.ndarray, walk: int, table: int, kind: int) -> np.ndarray:
        got = np.uint64(((kind * WALKS + walk) * TABLES + table + 1) * 0x9E3779B1)
        for share in self.share[walk, table].tolist():
            got = _mix(got + out[int(share * self.places(kind))])
        return got

    def seeded(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, start) of the windows that line up with a run of some piece; a start may lie before the document."""
        docs, starts = [], []
        for q, (lookup, place) in self.seeds.items():
            at, which = lookup(runs(h, q))
            within = doc[at] == doc[at + q - 1]
            docs.append(doc[at[within]])
            starts.append(at[within] - place[which[within]])
        if not docs:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        key = np.unique(np.concatenate(docs) * (1 << 40) + np.concatenate(starts) + PIECE)
        return key >> 40, (key & (1 << 40) - 1) - PIECE

    def meet(self, h: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, piece) that share a key in some table."""
        found = []
        most = self.places(int(self.used.max())) if len(self.used) else 0
        for part in (slice(a, a + AT_ONCE) for a in range(0, len(start), AT_ONCE)):
            for walk in range(WALKS):
                out = embed(h, start[part], low[part], high[part], walk, most)
                for kind in self.used.tolist():
                    for table in range(TABLES):
                        window, key = self.tables(self.key(out, walk, table, kind))
                        if len(window):
                            found.append(np.unique((window + part.start) * len(self.item) + key % len(self.item)))
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pair // max(1, len(self.item)), pair % max(1, len(self.item))

    def verify(self, h: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, start: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> (edits, start, words) of the best span near its windows, of those within the allowed edits."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        order = np.lexsort((start, doc, item))
        doc, low, high, item, start = (x[order] for x in (doc, low, high, item, start))
        # windows of one document and item no further apart than the edits are aligned together
        fresh = np.ones(len(item), dtype=bool)
        fresh[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(start) > np.maximum(self.edits[item[1:]], 1))
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(item))[: len(first)] - 1
        for i in np.unique(item[first]).tolist():
            n, e = int(self.size[i]), int(self.edits[i])
            own = np.flatnonzero(item[first] == i)
            at_once = max(1, (1 << 21) // (n + 2 * e + 1))
            for rows in (own[a : a + at_once] for a in range(0, len(own), at_once)):
                f = first[rows]
                begin = np.maximum(low[f], start[f] - e)
                stop = np.maximum(begin, np.minimum(high[f], start[last[rows]] + n + e))
                wide = int((stop - begin).max())
                place = begin[:, None] + np.arange(wide)
                region = np.where(place < stop[:, None], h[np.minimum(place, len(h) - 1)], _PAD)
                cost, came = align(self.words[self.begin[i] : self.begin[i] + n], region)
                cost = np.where(np.arange(wide + 1) <= (stop - begin)[:, None], cost, n + 1)
                end = cost.argmin(axis=1)
                for r in np.flatnonzero(cost[np.arange(len(f)), end] <= e).tolist():
                    b = int(came[r, end[r]])
                    got = int(cost[r, end[r]]), int(begin[r]) + b - int(low[f[r]]), int(end[r]) - b
                    pair = int(doc[f[r]]), i
                    best[pair] = min(best.get(pair, got), got)
        return best


def align(item: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of words: the least edits between the item and a span that ends before place j, and where it begins."""
    rows, wide = region.shape
    cost = np.zeros((rows, wide + 1), dtype=np.int64)
    begin = np.broadcast_to(np.arange(wide + 1), cost.shape).copy()
    for k, word in enumerate(item, 1):
        new = np.empty_like(cost)
        came = np.empty_like(begin)
        new[:, 0], came[:, 0] = k, 0
        replace = cost[:, :-1] + (region != word)
        drop = cost[:, 1:] + 1
        new[:, 1:] = np.minimum(replace, drop)
        came[:, 1:] = np.where(replace <= drop, begin[:, :-1], begin[:, 1:])
        # an inserted word costs 1 more than the place before: a running minimum of cost - place
        slope = new - np.arange(wide + 1)
        least = np.minimum.accumulate(slope, axis=1)
        source = np.maximum.accumulate(np.where(slope <= least, np.arange(wide + 1), 0), axis=1)
        new = least + np.arange(wide + 1)
        begin = np.take_along_axis(came, source, axis=1)
        cost = new
    return cost, begin


def find(items: Items, h: np.ndarray, count: np.ndarray | None = None, prefilter: bool = True) -> list[list[tuple[int, int, int, int]]]:
    """For documents whose words follow each other in h, count each: the best span of each item that they hold, as (item,
    start, words, edits). Without prefilter every window of every document is embedded."""
    count = np.array([len(h)]) if count is None else count
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(count))]
    if not len(h) or not len(items.size):
        return out
    stop = np.cumsum(count)
    begin = stop - count
    if prefilter:
        doc, start = items.seeded(h, np.repeat(np.arange(len(count)), count))
    else:
        doc = np.repeat(np.arange(len(count)), count + PIECE)
        start = ranges(begin - PIECE, count + PIECE)
    if not len(start):
        return out
    window, piece = items.meet(h, start, begin[doc], stop[doc])
    doc, item, at = doc[window], items.item[piece], start[window] - items.offset[piece]
    for (d, i), (edits, s, n) in sorted(items.verify(h, doc, begin[doc], stop[doc], item, at).items()):
        out[d].append((i, s, n, edits))
    return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of at most about BLOCK_BYTES, each built and sent before the next is read; items without
    words are left out."""
    ids, found, held = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        h = hashed(words(row.text))
        if not len(h):
            continue
        size = 32 * len(h) + (1 + len(h) // PIECE) * WALKS * TABLES * 20
        if ids and held + size > BLOCK_BYTES:
            yield Items(ids, found)
            ids, found, held = [], [], 0
        ids.append(row.item_id)
        found.append(h)
        held += size
    yield Items(ids, found)


def _batches(held, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int, int]]]]]:
    """Each chunk with what its documents hold."""
    for batch in pieces(batches):
        yield batch, find(held.value, *hashed_words(texts(batch.column("text"))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): one row per document and item that it holds.

    start and n_words: the best span, in words of the document; distance: its word edits; similarity: 1 - distance /
    words of the item. A null or empty text holds nothing, an item without words is nowhere. Items with the same text
    each get a row, and so do repeated documents. Null ids pass through; extra columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    out = None
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, found in _batches(held, batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(d, held.value.ids[i], s, n, e, 1 - e / int(held.value.size[i])) for d, own in zip(ids, found, strict=True) for i, s, n, e in own]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

        part = id_and_text(docs).mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no benchmark item. No shuffle: each is judged where it is read."""
    spark = docs.sparkSession
    ship(spark)
    out = docs.withColumn("text", F.col("text").cast("string"))
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, found in _batches(held, batches):
                yield batch.filter(pa.array([not own for own in found], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
