"""Substring dedup: words covered by a 13-word window that also starts in a document with a smaller id are removed.

Windows are found by super-k-mer partitioning. A window's minimiser is the smallest hashed 3-word piece in it;
consecutive windows with the same minimiser travel as one packed string of words to the minimiser's bucket. All
occurrences of a window have one minimiser, so a bucket can count its windows exactly: it sorts them by a hash, and
compares the words of those that meet. What a bucket finds goes back as word intervals of documents.

Against hot buckets: pieces that very many documents share (counted over all documents first) rank behind all others as
minimisers, so windows that only touch a common passage go where their own words send them, and windows wholly inside
it form equal strings, of which each map step ships those of its smallest document alone - the others are settled on
the spot. A map task also remembers such strings (``SEEN`` of them) from one step to the next.

Rows that share an id are told apart by a mark, a hash of their text: 32 bits where a count over all rows shows that these
tell all texts of each id apart, else 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.llm.common import hashes, id_and_text, pieces, texts, trim, word_array
from packsight.session import Scratch, ship

WINDOW, PIECE = 13, 3
#: A piece is common if it occurs more than once for this many documents ...
COMMON_SHARE = 0.004
#: ... and more often than this.
COMMON_LEAST = 64
#: Buckets for each shuffle partition.
BUCKETS = 4
#: Compression of what is shuffled.
LEVEL = 6
#: Strings of common passages that a map task remembers; more are shipped as they come.
SEEN = 100_000
#: Stands for a null id: larger than any other.
LAST = (1 << 63) - 1
FOUND = "key long, mark long, mark2 long, begin int, stop int"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _code(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, and a 64-bit hash of each number's word."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), hashes(coded.dictionary)


def _pieces(h: np.ndarray) -> np.ndarray:
    """A hash of every PIECE neighbouring words."""
    out = h[: len(h) - PIECE + 1].copy()
    for j in range(1, PIECE):
        out = (out ^ out >> np.uint64(29)) * _MIX + h[j : len(h) - PIECE + 1 + j]
    return (out ^ out >> np.uint64(32)) * _MIX


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, and where each text's begin and the last one's end."""
    words, count = word_array(texts(batch.column("text")))
    return words, np.concatenate(([0], np.cumsum(count)))


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that are common among the documents of one chunk, with their counts."""
    for batch in pieces(batches):
        code, own = _code(_words(batch)[0])
        if len(code) < PIECE:
            continue
        piece, count = np.unique(_pieces(own[code]), return_counts=True)
        often = count > max(COMMON_LEAST / 8, COMMON_SHARE * batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(piece[often].view(np.int64)), pa.array(count[often])], ["piece", "n"])


def common_pieces(docs: DataFrame) -> np.ndarray:
    """Hashes of the common pieces, sorted. It only steers the load: results are the same whatever is in it.

    A piece of more than COMMON_SHARE of all documents is common in some chunk. There are at most (words per
    document) / COMMON_SHARE of them, however many documents there are.
    """
    n = docs.count()
    found = docs.select("text").mapInArrow(_count_pieces, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > max(COMMON_LEAST, COMMON_SHARE * n)).select("piece").toLocalIterator()
    return np.sort(np.fromiter((r.piece for r in rows), dtype=np.int64).view(np.uint64))


#: Columns of a blob: key, mark and its second half, begin, and length or stop; with marks of 32 bits, and of 128.
COLUMNS = {False: ("<i8", "<i4", "<i1", "<i4", "<i4"), True: ("<i8", "<i8", "<i8", "<i4", "<i4")}


def _blob(wide: bool, *arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = np.array([len(arrays[0])], dtype="<i8").tobytes()
    return zstandard.compress(head + b"".join(a.astype(k).tobytes() for a, k in zip(arrays, COLUMNS[wide], strict=True)) + tail, LEVEL)


def _open(wide: bool, blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    size, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in COLUMNS[wide]:
        part = np.frombuffer(raw, kind, size, at)
        at += part.nbytes
        out.append(part.astype(np.int64))
    return out, raw[at:]


def _runs(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring places (at + 1) with equal ``of``: (first index, length)."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (of[1:] != of[:-1]))))
    return begins, np.diff(np.append(begins, len(at)))


def _send(common: np.ndarray, buckets: int, wide: bool):
    """Documents -> (bucket, settled, blob): super-k-mers for the buckets, and intervals that are settled already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        seen: dict[bytes, int] = {}
        for batch in pieces(batches):
            words, ends = _words(batch)
            if len(words) < WINDOW:
                continue
            code, own = _code(words)
            piece = _pieces(own[code])
            if len(common):
                near = np.minimum(np.searchsorted(common, piece), len(common) - 1)
                rank = piece >> np.uint64(1) | (common[near] == piece).astype(np.uint64) << np.uint64(63)
            else:
                rank = piece >> np.uint64(1)
            span = WINDOW - PIECE + 1
            low = rank[: len(words) - WINDOW + 1].copy()
            for j in range(1, span):
                np.minimum(low, rank[j : j + len(low)], out=low)
            doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            start = np.flatnonzero(doc[: len(low)] == doc[WINDOW - 1 :])
            if not len(start):
                continue
            first, count = _runs_by(doc[start], low[start], start)
            begin, stop = start[first], start[first] + count + WINDOW - 1
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(b" ", pa.large_binary()))[0].as_py()
            offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)
            left, right = (offsets[begin] + begin).tolist(), (offsets[stop] + stop - 1).tolist()
            strings = [joined[a:b] for a, b in zip(left, right, strict=True)]
            key, mark, mark2 = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "mark", "mark2"))
            of = doc[begin]
            same = pa.array(strings, pa.large_binary()).dictionary_encode().indices.to_numpy()
            least = np.full(int(same.max()) + 1, LAST, dtype=np.int64)
            np.minimum.at(least, same, key[of])
            mine = key[of] == least[same]
            for i in np.flatnonzero(mine & (low[begin] >> np.uint64(63) == 1)).tolist():
                own, before = int(key[of[i]]), seen.get(strings[i])
                if before is not None and before < own:
                    mine[i] = False
                elif before is not None or len(seen) < SEEN:
                    seen[strings[i]] = own
            settled = np.flatnonzero(~mine)
            if len(settled):
                turn += 1
                base = ends[of[settled]]
                columns = key[of[settled]], mark[of[settled]], mark2[of[settled]], begin[settled] - base, stop[settled] - base
                yield _row((turn * 7919 + len(settled)) % buckets, True, _blob(wide, *columns))
            ship_ = np.flatnonzero(mine)
            goes = (low[begin[ship_]] % np.uint64(buckets)).astype(np.int64)
            order = ship_[np.argsort(goes, kind="stable")]
            bounds = np.concatenate(([0], np.cumsum(np.bincount(goes, minlength=buckets))))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                part = order[bounds[b] : bounds[b + 1]]
                columns = key[of[part]], mark[of[part]], mark2[of[part]], begin[part] - ends[of[part]], stop[part] - begin[part]
                yield _row(b, False, _blob(wide, *columns, tail=b" ".join([strings[i] for i in part.tolist()])))

    return run


def _runs_by(doc: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))))
    return begins, np.diff(np.append(begins, len(at)))


def _row(bucket: int, settled: bool, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([settled]), pa.array([blob], pa.binary())], ["bucket", "settled", "blob"])


def count_windows(key: np.ndarray, length: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Super-k-mers of one bucket -> (super-k-mer, offset) of the windows that also start in one with a smaller key.

    length: words of each super-k-mer; words: all of them, one super-k-mer after the other.
    """
    code, own = _code(words)
    h = own[code]
    ends = np.cumsum(length)
    each = length - WINDOW + 1
    of = np.repeat(np.arange(len(key)), each)
    start = np.arange(len(of)) + np.repeat((ends - length) - (np.cumsum(each) - each), each)
    mixed = h[start]
    for j in range(1, WINDOW):
        mixed = (mixed ^ mixed >> np.uint64(31)) * _MIX + h[start + j]
    order = np.argsort(mixed)
    value = mixed[order]
    fresh = np.concatenate(([True], value[1:] != value[:-1]))
    # groups of windows with one hash: each is compared with the first, and goes if some window has a smaller key
    met = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    order, group = order[met], np.cumsum(fresh[met]) - 1
    first = np.flatnonzero(fresh[met])
    least = np.minimum.reduceat(key[of[order]], first) if len(first) else first
    twin = np.ones(len(order), dtype=bool)
    head, steps = start[order[first]][group] if len(first) else group, np.arange(WINDOW)
    for at in range(0, len(order), 1 << 16):
        part = slice(at, at + (1 << 16))
        twin[part] = (code[start[order[part]][:, None] + steps] == code[head[part][:, None] + steps]).all(axis=1)
    hit = order[key[of[order]] > least[group]] if len(first) else order
    if not twin.all():  # different windows with one hash: settle those groups by their words
        clash = np.isin(group, group[~twin])
        seen: dict[bytes, int] = {}
        windows = [(code[start[i] : start[i] + WINDOW].tobytes(), int(key[of[i]]), i) for i in order[clash].tolist()]
        for window, k, _ in windows:
            seen[window] = min(seen.get(window, k), k)
        extra = np.array([i for window, k, i in windows if seen[window] < k], dtype=np.int64)
        hit = np.concatenate((hit[~np.isin(hit, order[clash])], extra))
    hit = np.sort(hit)
    return of[hit], start[hit] - (ends - length)[of[hit]]


def _found(key: np.ndarray, mark: np.ndarray, mark2: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Intervals, those of a document merged where they touch."""
    order = np.lexsort((begin, mark2, mark, key))
    key, mark, mark2, begin, stop = (x[order] for x in (key, mark, mark2, begin, stop))
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]) | (mark2[1:] != mark2[:-1])))[: len(key)]
    lift = new.cumsum() * (1 << 32)
    reach = np.maximum.accumulate(stop + lift) - lift
    fresh = new.copy()
    fresh[1:] |= begin[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(key)) - 1
    columns = key[first], mark[first], mark2[first], begin[first].astype(np.int32), (reach[last] if len(first) else reach).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])


def _count(wide: bool, blobs: list[bytes]) -> pa.RecordBatch:
    opened = [_open(wide, b) for b in blobs]
    key, mark, mark2, begin, length = (np.concatenate([o[0][i] for o in opened]) for i in range(5))
    words = pc.split_pattern(pa.array([b" ".join(o[1] for o in opened)], pa.large_binary()), " ").flatten()
    which, offset = count_windows(key, length, words)
    first, count = _runs(which, offset)
    which, offset = which[first], offset[first]
    return _found(key[which], mark[which], mark2[which], begin[which] + offset, begin[which] + offset + count + WINDOW - 1)


def _receive(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs sorted by bucket -> the intervals that are to go. One bucket is held at a time."""
        bucket, blobs = None, []
        for batch in batches:
            for b, settled, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "settled", "blob")), strict=True):
                if settled:
                    yield _found(*_open(wide, blob)[0])
                    continue
                if b != bucket and blobs:
                    yield _count(wide, blobs)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield _count(wide, blobs)
        trim()

    return run


def keep_mask(n: int, intervals: list | None) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    for x in intervals or ():
        change[x["begin"]] += 1
        change[x["stop"]] -= 1
    return np.cumsum(change)[:n] == 0


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle to their intervals."""
    small = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches):
        packed = pa.array([None if t is None else small.compress(t) for t in texts(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "mark", "mark2")), packed], ["doc_id", "key", "mark", "mark2", "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    large = zstandard.ZstdDecompressor()
    for batch in batches:
        split = [large.decompress(t).split() if t else [] for t in batch.column("packed").to_pylist()]
        removed, kept = [], []
        for words, intervals in zip(split, batch.column("gone").to_pylist(), strict=True):
            mask = keep_mask(len(words), intervals)
            kept.append(b" ".join([w for w, k in zip(words, mask.tolist(), strict=True) if k] if intervals else words))
            removed.append(len(words) - int(mask.sum()))
        columns = [batch.column("doc_id"), pa.array([len(s) for s in split], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document's text without the words of windows that occurred before.

    kept: the words left, joined by one space. A null text has no words. A null id is larger than any other and equal
    to itself; rows that share an id are one document as far as "smaller" goes, so repeated rows do not remove each
    other's words. A window that a document repeats is not removed for that. Texts of fewer than 13 words stay whole.
    Extra columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    body = id_and_text(docs)
    key, mark, other = F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.hash("text").cast("long").alias("mark"), F.xxhash64("text")
    same = body.select(key, mark, other.alias("other")).groupBy("key", "mark").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    wide = same.where("lo != hi").limit(1).count() > 0
    marks = (other.alias("mark"), F.xxhash64(F.lit(1), "text").alias("mark2")) if wide else (mark, F.lit(0).cast("long").alias("mark2"))
    keyed = body.select("doc_id", key, *marks, "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = keyed.select("key", "mark", "mark2", "text").mapInArrow(_send(common_pieces(body), partitions * BUCKETS, wide), "bucket int, settled boolean, blob binary")
    found = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_receive(wide), FOUND)
    gone = found.groupBy("key", "mark", "mark2").agg(F.collect_list(F.struct("begin", "stop")).alias("gone"))
    packed = keyed.mapInArrow(_pack, "doc_id long, key long, mark long, mark2 long, packed binary")
    return packed.join(gone, ["key", "mark", "mark2"], "left").select("doc_id", "packed", "gone").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The query's rows in DuckDB's SQL.
SQL = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, words[i : i + {WINDOW - 1}] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM doc WHERE len(words) >= {WINDOW})),
least AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w HAVING count(*) > 1),
bad AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + {WINDOW})) AS spot FROM win JOIN least USING (w) WHERE least.first < win.doc_id),
gone AS (SELECT doc_id, list(spot) AS ats FROM bad GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(words) AS n, words, list_filter(range(1, len(words) + 1), lambda x: NOT list_contains(coalesce(ats, []), x)) AS places
  FROM doc LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(places))::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(places, lambda x: words[x]), ' ')) AS kept_sha256
FROM kept
"""
