"""Token-id shards: one concatenated id array, with Elias-Fano document boundaries.

A shard is a self-contained byte string:

    header    magic, version, bytes per id, and the counts below
    doc ids   Elias-Fano (ascending, stored less the smallest one)
    ends      Elias-Fano (end offset of each document within the shard)
    ids       little-endian unsigned integers, 2 bytes each if the vocabulary
              allows it, else 4

An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n))
bits: the low bits of each value packed, the high bits as a unary bit vector,
and the position of every 512th set bit, so that `select` reads one short run of
words for any document.  No table of 64-bit offsets is stored.

Shards are rows of a Parquet table (part, seq, n_docs, n_ids, blob), so they can
be written to and read from any store that Spark reaches; `blob` alone can be
saved as a file and mapped by `Shard`.

Defined results: a null text counts as empty and holds the end id only; rows
with a null doc_id come first, in shards of their own kind (flag in the header);
rows that share a doc_id follow each other by a hash of their text and then the text;
texts of any length are taken whole, and one that is longer than a shard gets a shard of
its own; further columns, whatever their names, are not looked at; an empty table gives
no shard.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import pick, scratch_path, small_batches, table, width

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: A shard is closed once it holds this many ids; a document is never split.
SHARD_IDS = 250_000
SAMPLE = 512
HEADER = struct.Struct("<4sHHQQqQ")
MAGIC = b"TWEF"


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence of unsigned integers with select access."""

    HEAD = struct.Struct("<QBQQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ups = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ups[-1]) // 64 + 1) * 64 if n else 0, dtype=np.uint8)
        bits[ups] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        if low_bits:
            lows = values & np.uint64((1 << low_bits) - 1)
            flat = ((lows[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            low = np.packbits(flat, bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, low_bits, low, high, ups[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, "<u8", b, at + a)
        samples = np.frombuffer(data, "<u8", c, at + a + 8 * b)
        return cls(n, low_bits, low, high, samples), at + a + 8 * b + 8 * c

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled bit onwards."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = at // 64
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return ((word * 64 + (bits & -bits).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (chunk >> (first % 8)) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        ups = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ups - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            flat = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (flat.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


# -------------------------------------------------------------------- shards


def write_shard(doc_ids: list[int | None], parts: list[np.ndarray], wide: bool) -> bytes:
    """The bytes of one shard; doc_ids ascend, or are all null."""
    null = bool(doc_ids) and doc_ids[0] is None
    base = 0 if null or not doc_ids else doc_ids[0]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    keys = EliasFano.build(np.zeros(0) if null else np.array([d - base for d in doc_ids], dtype=np.uint64))
    ends = EliasFano.build(np.cumsum([len(p) for p in parts]))
    head = HEADER.pack(MAGIC, 1 + null, 4 if wide else 2, len(parts), len(ids), base, 0)
    return head + keys.to_bytes() + ends.to_bytes() + ids.astype("<u4" if wide else "<u2").tobytes()


class Shard:
    """Reads a shard's bytes in place."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        magic, kind, size, self.n_docs, self.n_ids, self.base, _ = HEADER.unpack_from(view, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.null_keys = kind == 2
        self.keys, at = EliasFano.from_bytes(view, HEADER.size)
        self.ends, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view, "<u4" if size == 4 else "<u2", self.n_ids, at)

    def doc_id(self, i: int) -> int | None:
        return None if self.null_keys else self.base + self.keys.select(i)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]


# ------------------------------------------------------------------ encoding

#: What \s stands for in the byte-level splitter, as a class of Arrow's regular expressions.
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A space beside other white space, or at either end of the text: cuts there could change tokens.
ODD = rf"{WHITE} | {WHITE}|\A | \z"
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces kept in a worker at most, some 200 bytes each; beyond it those met once go.
CACHE = 400_000
#: Characters that are encoded together, a text's at least: repeated pieces are looked up once in them.
RUN = 2_000_000
#: Characters that the library gets in one call.
CALL = 500_000


class Encoder:
    """Encodes whole texts with the tokenizers library, keeping the ids of pieces it has met.

    A text is cut before single spaces that have no other white space beside them.
    With a byte-level splitter no token crosses such a cut, so the ids of " piece" can be
    kept and reused, and pieces not met before go to the library in one text, whose ids
    are dealt to the pieces by their lengths in bytes.  Texts that hold an added token's
    string, and all texts under other kinds of tokenizer, are encoded in one go.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        split = about["pre_tokenizer"] or {}
        self.added = [a["content"] for a in about["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.by_piece = (
            about["normalizer"] is None
            and about["model"]["type"] == "BPE"
            and not about["model"].get("ignore_merges")
            and split.get("type") == "ByteLevel"
            and not split["add_prefix_space"]
            and split["use_regex"]
            and not any(" " in a for a in self.added)
            and sum(len(t) == 1 for t in vocabulary) >= 256
        )
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        # In a byte-level vocabulary each letter of a token stands for one byte.
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.n_bytes[k] = len(token)
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.hits = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep_often(self) -> None:
        """Forgets the pieces met once."""
        often = self.hits > 1
        size = np.diff(self.starts)
        self.ids = self.ids[np.repeat(often, size)]
        self.starts = np.concatenate([[0], np.cumsum(size[often])])
        kept = (p for p, good in zip(self.index, often, strict=True) if good)
        self.index = {p: k for k, p in enumerate(kept)}
        self.hits = self.hits[often] // 2

    def _learn(self, pieces: list[str]) -> None:
        ids, sizes = [self.ids], []
        for _, some in in_chunks(pieces, CALL):
            found = self._library([" " + " ".join(some)])[0]
            stops = np.cumsum(self.n_bytes[found])
            wanted = np.cumsum(1 + pc.binary_length(pa.array(some, pa.string())).to_numpy())
            ends = np.searchsorted(stops, wanted)
            if len(stops) != ends[-1] + 1 or not np.array_equal(stops[ends], wanted):
                raise ValueError("a token crosses a cut: this is no byte-level tokenizer")
            ids.append(found)
            sizes.append(np.diff(ends, prepend=-1))
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces)), strict=True))
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        self.hits = np.concatenate([self.hits, np.zeros(len(pieces), np.int64)])

    def _joined(self, cut: pa.Array) -> list[np.ndarray]:
        """The ids of each text, given as the list of its pieces; each piece but the first follows a space."""
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())
        firsts = np.concatenate([[0], ends[:-1]])
        pieces = cut.flatten()
        out = self._library(pieces.take(pa.array(firsts)).to_pylist())
        later = np.ones(len(pieces), bool)
        later[firsts] = False
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        if not len(coded):
            return out
        if len(self.index) > CACHE:
            self._keep_often()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            # New pieces are numbered in their order here, after those that are kept.
            known[fresh] = np.arange(len(self.index), len(self.index) + len(fresh))
            self._learn([distinct[i] for i in fresh])
        at = known[coded.indices.to_numpy()]
        self.hits += np.bincount(at, minlength=len(self.hits))
        first = self.starts[at]
        size = self.starts[at + 1] - first
        stops = np.cumsum(size)
        ids = self.ids[np.repeat(first - (stops - size), size) + np.arange(stops[-1])]
        places = np.concatenate([[0], stops])[np.concatenate([[0], ends - np.arange(1, len(cut) + 1)])]
        return [np.concatenate([head, ids[a:b]]) for head, a, b in zip(out, places[:-1], places[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        whole = np.array([not self.by_piece or any(a in t for a in self.added) for t in texts])
        given = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(given, ODD).to_numpy(zero_copy_only=False) & ~whole
        out: list[np.ndarray | None] = [None] * len(texts)
        for at, found in (
            (np.flatnonzero(whole), lambda at: self._library([texts[i] for i in at])),
            (np.flatnonzero(odd), lambda at: self._joined(pa.array([SAFE.split(texts[i]) for i in at], pa.list_(pa.string())))),
            (np.flatnonzero(~odd & ~whole), lambda at: self._joined(pc.split_pattern(given.take(pa.array(at)), " "))),
        ):
            if len(at):
                for i, ids in zip(at, found(at), strict=True):
                    out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder per worker and vocabulary file; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """The same (doc_id, text) rows in lists of `most` characters or a batch more."""
    keys: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        keys += batch.column(0).to_pylist()
        texts += (more := batch.column(1).to_pylist())
        size += sum(map(len, more))
        if size >= most:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def in_chunks(texts: list[str], most: int = RUN) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts that together have about `most` characters, one text at least."""
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    at = 0
    while at < len(texts):
        before = stops[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(stops, before + most, "right")))
        yield at, texts[at:end]
        at = end


# --------------------------------------------------------------- the operator

SHARDS = "part int, seq int, n_docs long, n_ids long, blob binary"


def encode_shards(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of all documents, in ascending doc_id order by (part, seq)."""
    df = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("doc_id", F.col("doc_id").cast("long"))
    small_batches(docs.sparkSession)
    # The bounds of the ranges are sampled rows that reach the driver: a hash stands for the text there.
    df = df.repartitionByRange(width(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    df = df.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_for(vocabulary_path(vocabulary))
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            blob = write_shard(keys, parts, encoder.wide)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "blob"])

        end = np.array([end_id], dtype=np.uint32)
        for ids, several in _runs(batches, RUN):
            for at, texts in in_chunks(several):
                for key, found in zip(ids[at : at + len(texts)], encoder.encode(texts), strict=True):
                    if keys and (held >= shard_ids or (keys[0] is None) != (key is None)):
                        yield close()
                        seq, keys, parts, held = seq + 1, [], [], 0
                    keys.append(key)
                    parts.append(np.concatenate([found, end]))
                    held += len(found) + 1
        if keys:
            yield close()

    return df.mapInArrow(run, SHARDS)


def save_shards(shards: DataFrame, path: str) -> None:
    shards.write.option("compression", "zstd").parquet(path)


def load_index(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' bytes alone."""
    small_batches(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(blob.as_buffer())
                ends = shard.ends.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                keys = pa.nulls(shard.n_docs, pa.int64()) if shard.null_keys else pa.array(shard.keys.all() + shard.base, pa.int64())
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                where = [pa.array(np.full(shard.n_docs, x, np.int32)) for x in (part, seq)]
                yield pa.RecordBatch.from_arrays([*where, keys, pa.array(starts), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    held = shards.select("part", "seq", "blob").mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # Where each shard begins, from its count of ids: sums of parts (one row each) before, and of its own part's earlier shards.
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("held"))
    parts = per_part.select(F.col("part").alias("of"), (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    places = shards.select("part", "seq", within.alias("offset"))
    places = places.join(parts, F.col("part") == F.col("of")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("base") + F.col("offset")).alias("base"))
    # What moves here is a small row per document, never a shard's bytes.
    df = held.join(places, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    return df.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokenise(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shards of `docs` to `path` and returns their index, read back from there."""
    save_shards(encode_shards(docs, **options), path)
    return load_index(docs.sparkSession.read.schema(SHARDS).parquet(path))


def op2_token_shards(spark, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
