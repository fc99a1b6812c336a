"""Token-ID output: documents in ascending doc_id order as shards of Re-Pair compressed token ids.

Documents are range-partitioned by id, tokenised behind that shuffle (its sampling pass then only reads) and packed
into shards of about ``SHARD_TOKENS`` ids. The shards are rows of a Parquet table (part, number, counts, blob) that Spark's
own writer commits, so any store that Spark writes will do and a lost task is written again, the same. ``repair``
describes the blob.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsight.llm.common import held, id_and_text, pieces
from packsight.llm.repair import Shard, pack
from packsight.session import Scratch, ship

END = 1

# The normaliser and the cut into pieces for which ``cut`` is written. Other tokenizers see whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# Byte-level tokens write bytes that are no printable character as the characters from 256 on.
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}

#: What a byte is: letters are those of ASCII and of Latin-1 (lead byte C3), and a word with an odd byte stays whole.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
KIND = np.full(256, ODD, dtype=np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = LETTER
KIND[ord("'")] = ODD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Finds in a piece what makes it odd.
ODDITY = re.compile(rb"[\x00-\x08\x0e-\x1f'\x7f\xc0-\xc2\xc4-\xff]|\xc3[\x97\xb7]|<\|")

SHARD_TOKENS = 1 << 20
#: Pieces whose ids a Python worker remembers, some 200 bytes each; beyond, it keeps those of the texts at hand.
REMEMBERED = 500_000
SCHEMA = "part int, number int, first_id long, n_docs long, n_tokens long, start_in_part long, blob binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int"


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str) -> Encoder:
    return held(("tokenizer", path), lambda: Encoder(path))


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts, each with a space behind it -> where the tokenizer's pieces begin, their lower-cased bytes without
    the spaces, and where each piece begins in those.

    A piece is a run of letters, a digit or a run of signs. A word with anything else in it - other scripts, apostrophes,
    marks of special tokens - is one piece as it stands, for the tokenizer to normalise and to cut.
    """
    kind, low = KIND[data], LOWER[data]
    second = np.flatnonzero(data == 0xC3) + 1
    what = data[second]
    low[second[(what <= 0x9E) & (what != 0x97)]] += 0x20
    kind[second[(what == 0x97) | (what == 0xB7)]] = ODD
    kind[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = ODD
    space = kind == SPACE
    fresh = np.ones(len(data), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh |= kind == DIGIT
    fresh &= ~space
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        gaps = np.flatnonzero(space)
        word = np.unique(np.searchsorted(gaps, odd))
        begin, stop = np.where(word > 0, gaps[word - 1] + 1, 0), gaps[word]
        size = stop - begin
        at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
        fresh[at], low[at] = False, data[at]
        fresh[begin] = True
    starts = np.flatnonzero(fresh)
    return starts, low[~space], starts - np.cumsum(space, dtype=np.int32)[starts]


class Encoder:
    """The tokenizer, asked once for each distinct piece that a worker meets.

    Its file is compared with what ``cut`` knows; texts of any other tokenizer go to the library whole. White space is
    dropped by this one, and no token, normalisation or added token spans any, so a text's ids are those of its pieces
    one after the other. numpy cuts, Arrow finds the distinct pieces, and the library's model merges each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.fast = self._known_cut()
        self.forget()

    def _known_cut(self) -> bool:
        parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if any(p is None for p in parts) or any(x is not None for x in (self.tokenizer.post_processor, self.tokenizer.truncation, self.tokenizer.padding)):
            return False
        normalizer, cutter = (json.loads(p.__getstate__()) for p in parts)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized}
        plain = len(added) == len(self.tokenizer.get_added_tokens_decoder()) and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)
        return plain and normalizer == NORMALIZER and cutter == {"type": "Sequence", "pretokenizers": [PIECES, BYTE_LEVEL]}

    def forget(self) -> None:
        """Code 0 is the end of a document."""
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = array("I", [END]), array("L", [0, 1])

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Stores the ids of new pieces; the place in the store's order that each got, from 0."""
        odd: list[int] = []
        known, ends, extend, merge, oddity = self.known, self.ends, self.flat.extend, self.tokenizer.model.tokenize, ODDITY.search
        for i, piece in enumerate(pieces):
            if piece.isalpha():
                extend([t.id for t in merge(piece.decode())])
            elif not oddity(piece):
                extend([t.id for t in merge(piece.decode("latin-1").translate(BYTES))])
            else:
                odd.append(i)
                continue
            known[piece] = len(ends) - 1
            ends.append(len(self.flat))
        for at in range(0, len(odd), 10_000):
            part = [pieces[i] for i in odd[at : at + 10_000]]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                known[piece] = len(ends) - 1
                extend(got.ids)
                ends.append(len(self.flat))
        last = np.zeros(len(pieces), dtype=bool)
        last[odd] = True
        order = np.empty(len(pieces), dtype=np.int64)
        order[np.argsort(last, kind="stable")] = np.arange(len(pieces))
        return order

    def codes(self, pieces: list[bytes]) -> np.ndarray:
        """A code for each of these distinct pieces."""
        got = list(map(self.known.get, pieces))
        new = [p for p, c in zip(pieces, got, strict=True) if c is None]
        if new and len(self.known) + len(new) > REMEMBERED:
            flat, ends = self.flat, self.ends
            self.forget()
            for p, c in zip(pieces, got, strict=True):
                if c is not None:
                    self.known[p] = len(self.ends) - 1
                    self.flat.extend(flat[ends[c] : ends[c + 1]])
                    self.ends.append(len(self.flat))
            self.learn(new)
            return np.fromiter(map(self.known.get, pieces), dtype=np.int64, count=len(pieces))
        first = len(self.ends) - 1
        order = self.learn(new)
        codes = np.array([-1 if c is None else c for c in got], dtype=np.int64)
        codes[codes < 0] = first + order
        return codes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and how many each text has."""
        plain = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
        if not self.fast:
            got = [[*g.ids, END] for g in self.tokenizer.encode_batch_fast([t.decode() for t in plain], add_special_tokens=False)]
            return np.array([i for g in got for i in g], dtype=np.uint32), np.array([len(g) for g in got], dtype=np.int64)
        data = np.frombuffer(b"\n".join([*plain, b""]), dtype=np.uint8)
        starts, values, offsets = cut(data)
        stops = np.cumsum([len(t) + 1 for t in plain]) - 1
        offsets = np.append(offsets, len(values))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).dictionary_encode()
        code = self.codes(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        last = np.searchsorted(starts, stops)
        sequence = np.insert(code, last, 0)
        flat, ends = np.frombuffer(self.flat, dtype=np.uint32), np.frombuffer(self.ends, dtype=np.uint64).astype(np.int64)
        count = np.diff(ends)[sequence]
        upto = np.concatenate(([0], np.cumsum(count)))
        ids = flat[np.arange(upto[-1]) + np.repeat(ends[sequence] - upto[:-1], count)]
        del flat  # else the store could not grow
        return ids, np.diff(np.concatenate(([0], upto[last + np.arange(1, len(last) + 1)])))


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            row = [part, number, ids[0], len(ids), held, start, pack(ids, tokens, encoder.size)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in pieces(batches, limit=3 << 20, keep=("tokenizer", path)):
            flat, counts = encoder(batch.column("text"))
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                if ids and held + len(got) > SHARD_TOKENS:
                    yield shard()
                    number, start, held = number + 1, start + held, 0
                    ids, tokens = [], []
                ids.append(doc_id)
                tokens.append(got)
                held += len(got)
        if ids:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the shards of all documents under ``path``, replacing what is there.

    Every row gets the ids of its whole text and the end id; null and empty texts the end id alone. Rows without an id
    come first; rows that share an id are ordered by a hash of their text, equal rows are all kept. Extra columns are
    not read.
    """
    ship(docs.sparkSession)
    keyed = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    shards = dealt.select("doc_id", "text").mapInArrow(_write(vocabulary or vocabulary_file()), SCHEMA)
    shards.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the shards: doc_id, start, n_tokens, ids_crc32, part, shard, and the ids themselves if wanted.

    What goes to the driver is one sum for each partition of the writing job.
    """
    ship(spark)
    shards = spark.read.schema(SCHEMA).parquet(path)
    sums = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_tokens")).collect()))
    starts = dict(zip([p for p, _ in sums], np.cumsum([0] + [n for _, n in sums]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, begin, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "start_in_part", "blob")), strict=True):
                shard = Shard(blob)
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.doc_tokens)
                spans = list(zip((ends - shard.doc_tokens).tolist(), ends.tolist(), strict=True))
                crc = [zlib.crc32(ids[a:b]) for a, b in spans]
                base = starts[part] + begin
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(ends - shard.doc_tokens + base), pa.array(shard.doc_tokens), pa.array(crc, pa.int64()), pa.array([part] * len(crc), pa.int32()), pa.array([number] * len(crc), pa.int32())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return shards.select("part", "number", "start_in_part", "blob").mapInArrow(run, RESULT + (", ids array<long>" if with_ids else ""))


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the documents' shards to the shared folder and read them back as one digest row per document."""
    path = f"{Scratch(docs.sparkSession, 'tokens').root}/shards"
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path)
