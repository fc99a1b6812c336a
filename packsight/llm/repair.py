"""Re-Pair grammar compression of integer sequences, in numpy.

Pairs of neighbouring symbols that are frequent are replaced by new symbols (nonterminals), round after round, until no
pair is frequent or the symbols are used up. Counts are exact: every round sorts the pairs. One that overlaps more
frequent ones wherever it occurs waits for a later round.

A shard's blob holds the rules, how many ids each nonterminal expands to, the remaining symbols and, for every
``STRIDE``-th symbol, its place in the expanded sequence, so that one document can be decoded without the others.

Layout, little-endian: magic ``RPR1``, crc32 of all that follows (uint32), then a header of seven int64 (documents,
ids, symbols, rules, first nonterminal, bytes per symbol, stride) and the arrays doc_ids int64, doc_null uint8,
doc_tokens int64, left uint32, right uint32, expansion uint32, places int64, symbols uint16 or uint32.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPR1"
STRIDE = 1024
#: A pair must occur this often in its shard to be worth a rule.
LEAST = 6
PER_ROUND = 8192
#: Slots of the table that tells a round's pairs; of pairs that share a slot the most frequent is taken, others wait.
SLOTS_LOG2 = 18
#: An odd multiplier for hashing pairs into slots.
MULTIPLIER = 0x9E3779B97F4A7C15


@dataclass
class Grammar:
    first: int
    left: np.ndarray
    right: np.ndarray
    symbols: np.ndarray

    def expansion(self) -> np.ndarray:
        """Ids that each nonterminal stands for. A rule only names earlier rules."""
        size = np.ones(len(self.left), dtype=np.int64)
        done = np.zeros(len(self.left), dtype=bool)
        while not done.all():
            ready = ~done
            for side in (self.left, self.right):
                inner = side >= self.first
                ready &= ~inner | done[np.where(inner, side - self.first, 0)]
            size[ready] = sum(np.where(s[ready] >= self.first, size[np.maximum(s[ready] - self.first, 0)], 1) for s in (self.left, self.right))
            done |= ready
        return size


def frequent(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur ``LEAST`` times or more, and how often."""
    if len(key) < LEAST:
        return key[:0], np.zeros(0, dtype=np.int64)
    row = np.sort(key)
    often = row[: len(row) - LEAST + 1] == row[LEAST - 1 :]
    often[1:] &= row[1 : len(often)] != row[: len(often) - 1]
    first = np.flatnonzero(often)
    pair = row[first]
    return pair, np.searchsorted(row, pair, side="right") - first


def _slot(pair: np.ndarray) -> np.ndarray:
    bits = 8 * pair.itemsize
    return (pair * pair.dtype.type(MULTIPLIER & (1 << bits) - 1) >> pair.dtype.type(bits - SLOTS_LOG2)).astype(np.int32)


def compress(ids: np.ndarray, first: int) -> Grammar:
    """ids: below ``first``, the first nonterminal. New symbols stay below 2^16 where ``first`` does."""
    narrow = first < 1 << 16
    symbol, wide, shift = (np.uint16, np.uint32, 16) if narrow else (np.uint32, np.uint64, 32)
    room = ((1 << 16) if narrow else (1 << 31)) - first
    seq = ids.astype(symbol)
    left, right = [], []
    made = 0
    while len(seq) > 1 and made < room:
        key = seq[:-1].astype(wide) << wide(shift) | seq[1:]
        pair, count = frequent(key)
        if not len(pair):
            break
        best = np.lexsort((_slot(pair), -count))[: min(PER_ROUND, room - made)]
        _, own = np.unique(_slot(pair[best]), return_index=True)
        pair = pair[best[np.sort(own)]]
        slot = _slot(pair)
        number, held = np.full(1 << SLOTS_LOG2, len(pair), dtype=np.uint16), np.zeros(1 << SLOTS_LOG2, dtype=wide)
        number[slot], held[slot] = np.arange(len(pair)), pair
        slot = _slot(key)
        rank = number[slot]
        rank[held[slot] != key] = len(pair)
        # of overlapping pairs the more frequent one is replaced, the same wherever they meet; of one pair's run every second
        chosen = rank < len(pair)
        chosen[1:] &= rank[1:] <= rank[:-1]
        chosen[:-1] &= rank[:-1] <= rank[1:]
        at = np.flatnonzero(chosen)
        begins = np.concatenate(([True], np.diff(at) > 1))
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[since % 2 == 0]
        rule = rank[at]
        worth = np.bincount(rule, minlength=len(pair)) >= LEAST // 2
        used = np.flatnonzero(worth)
        at = at[worth[rule]]
        rule = rank[at]
        to = np.zeros(len(pair), dtype=symbol)
        to[used] = first + made + np.arange(len(used))
        left.append((pair[used] >> wide(shift)).astype(np.int64))
        right.append((pair[used] & wide((1 << shift) - 1)).astype(np.int64))
        seq[at] = to[rule]
        made += len(used)
        kept = np.ones(len(seq), dtype=bool)
        kept[at + 1] = False
        seq = seq[kept]
    none = np.zeros(0, dtype=np.int64)
    return Grammar(first, np.concatenate(left) if left else none, np.concatenate(right) if right else none, seq.astype(np.int64))


def _open(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rules opened level by level until only ids are left."""
    seq = symbols.astype(np.int64)
    while (open_ := seq >= first).any():
        place = np.arange(len(seq)) + np.cumsum(open_) - open_
        out = np.empty(len(seq) + int(open_.sum()), dtype=np.int64)
        out[place[~open_]] = seq[~open_]
        rule = seq[open_] - first
        out[place[open_]] = left[rule]
        out[place[open_] + 1] = right[rule]
        seq = out
    return seq


def expand(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for. Rules are opened once, each; symbols then copy what theirs came to."""
    used = np.unique(symbols[symbols >= first]) - first
    flat = np.concatenate((_open(used + first, first, left, right), np.arange(first)))
    begin = np.zeros(first + len(left), dtype=np.int64)
    count = np.ones(first + len(left), dtype=np.int64)
    begin[used + first] = np.cumsum(size[used]) - size[used]
    count[used + first] = size[used]
    begin[:first] = int(size[used].sum()) + np.arange(first)
    each = count[symbols]
    upto = np.cumsum(each)
    return flat[np.repeat(begin[symbols] - (upto - each), each) + np.arange(int(upto[-1]) if len(upto) else 0)]


def pack(doc_ids: list[int | None], tokens: list[np.ndarray], first: int) -> bytes:
    ids = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
    grammar = compress(ids, first)
    size = grammar.expansion()
    inner = grammar.symbols >= first
    each = np.where(inner, size[np.where(inner, grammar.symbols - first, 0)] if len(size) else 1, 1)
    places = (np.cumsum(each) - each)[::STRIDE]
    wide = first + len(size) > 1 << 16
    header = struct.pack("<7q", len(doc_ids), len(ids), len(grammar.symbols), len(size), first, 4 if wide else 2, STRIDE)
    arrays = (
        np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype="u1"),
        np.array([len(t) for t in tokens], dtype="<i8"), grammar.left.astype("<u4"), grammar.right.astype("<u4"),
        size.astype("<u4"), places.astype("<i8"), grammar.symbols.astype("<u4" if wide else "<u2"),
    )
    body = header + b"".join(a.tobytes() for a in arrays)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Shard:
    """A blob opened for reading."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC or struct.unpack_from("<I", blob, 4)[0] != zlib.crc32(memoryview(blob)[8:]):
            raise ValueError("not a whole Re-Pair shard")
        docs, self.n_ids, symbols, rules, self.first, width, self.stride = struct.unpack_from("<7q", blob, 8)
        at = 8 + 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.doc_tokens = take("<i8", docs)
        self.left, self.right, self.size = (take("<u4", rules).astype(np.int64) for _ in range(3))
        self.places = take("<i8", -(-symbols // self.stride))
        self.symbols = take("<u4" if width == 4 else "<u2", symbols)

    def ids(self) -> np.ndarray:
        return expand(self.symbols.astype(np.int64), self.first, self.left, self.right, self.size)

    def document(self, i: int) -> np.ndarray:
        """One document's ids; only the symbols that cover it are opened."""
        begin = int(self.doc_tokens[:i].sum())
        end = begin + int(self.doc_tokens[i])
        if begin == end:
            return np.zeros(0, dtype=np.int64)
        block = int(np.searchsorted(self.places, begin, side="right")) - 1
        last = int(np.searchsorted(self.places, end, side="left"))
        part = self.symbols[block * self.stride : last * self.stride]
        base = int(self.places[block])
        return _open(part, self.first, self.left, self.right)[begin - base : end - base]
