"""Removing lines that many documents share, with two Bloom filters.

1. Every partition reports where the keys of its documents fall in a Bloom
   filter: the places it has met, and those met by two documents of its own.
   The filter is cut into segments of fixed size, a key falls in one segment
   only, and each segment is merged by itself into a once-seen and a twice-seen
   filter.  A key that two documents hold is always in the twice-seen filter.
2. Only keys found there are suspects.  They are counted by document within each
   partition and then shuffled as whole keys, for exact counts.
3. The texts are read once more and lose the lines of the confirmed keys.

The filter grows with the number of lines.  Where its twice-seen part is larger
than `filter_mb`, step 2 runs once per slice of segments, so no task and no
broadcast ever holds more.  Confirmed keys are broadcast up to `broadcast_keys`;
beyond that they are joined to the suspects, and only each document's own set of
doomed keys meets its text.  Both ways give the same result.

Defined results: a null or empty text is one empty line, which stays; an empty
key is never dropped; a null doc_id is treated like any other; repeated rows
count as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import materialise, pick, table

STRIP = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
#: Bits of a segment, bits per key (for two places each), and the bounds described above.
SEGMENT_BITS = 1 << 23
BITS_PER_KEY = 16
FILTER_MB = 64
BROADCAST_KEYS = 1_000_000


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each key."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, keys)), "<u8").reshape(-1, 2)


def _places(pairs: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each key and its two places within."""
    segment = (pairs[:, 0] % np.uint64(segments)).astype(np.int64)
    first = ((pairs[:, 0] // np.uint64(segments)) % np.uint64(bits)).astype(np.int64)
    second = (pairs[:, 1] % np.uint64(bits)).astype(np.int64)
    return segment, first, second


def _pack(places: np.ndarray) -> bytes:
    """Ascending places as compressed gaps."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<u4"), dtype=np.int64)


def _document_keys(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    for text in texts:
        yield list({k for k in map(line_key, (text or b"").split(b"\n")) if k})



def twice_seen(texts: DataFrame, segments: int, bits: int = SEGMENT_BITS) -> DataFrame:
    """(segment, places): the set bits of the twice-seen filter, by segment."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(0, np.int64)
        twice = np.zeros(0, np.int64)
        for batch in batches:
            keys = [k for own in _document_keys(batch.column(0).to_pylist()) for k in own]
            if not keys:
                continue
            segment, first, second = _places(_digests(keys), segments, bits)
            flat = np.concatenate([segment * bits + first, (segment * bits + second)[first != second]])
            met, counts = np.unique(flat, return_counts=True)
            twice = np.union1d(twice, np.concatenate([met[counts > 1], np.intersect1d(met, once, assume_unique=True)]))
            once = np.union1d(once, met)
        if len(once):
            found = np.unique(once // bits)
            cuts = [np.searchsorted(x, [found * bits, (found + 1) * bits]) for x in (once, twice)]
            packed = [[_pack(x[a:b] - s * bits) for s, a, b in zip(found, *cut, strict=True)] for x, cut in zip((once, twice), cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], names=["segment", "once", "twice"])

    def merge(own: pa.Table) -> pa.Table:
        once = np.zeros(bits, bool)
        twice = np.zeros(bits, bool)
        for met, met_twice in zip(own.column("once").to_pylist(), own.column("twice").to_pylist(), strict=True):
            places = _unpack(met)
            twice[_unpack(met_twice)] = True
            twice[places[once[places]]] = True
            once[places] = True
        places = np.flatnonzero(twice)
        return pa.table({"segment": own.column("segment")[:1], "n": pa.array([len(places)], pa.int64()), "places": pa.array([_pack(places)], pa.binary())})

    reports = texts.mapInArrow(report, "segment long, once binary, twice binary")
    return reports.groupBy("segment").applyInArrow(merge, "segment long, n long, places binary")


def _suspects(texts: DataFrame, segments: int, bits: int, filters: dict[int, bytes]) -> DataFrame:
    """(key, digest, n, owner) of rows (text, doc_id): suspected keys, how many of a partition's documents hold them, and the smallest doc_id of those."""
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {s: np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), bitorder="little").astype(bool) for s, b in sent.value.items()}
        counts: Counter[bytes] = Counter()
        owner: dict[bytes, int | None] = {}
        for batch in batches:
            docs = list(_document_keys(batch.column(0).to_pylist()))
            keys = [k for doc in docs for k in doc]
            if not keys:
                continue
            ids = [i for i, doc in zip(batch.column(1).to_pylist(), docs, strict=True) for _ in doc]
            segment, first, second = _places(_digests(keys), segments, bits)
            for s in np.intersect1d(segment, list(own)):
                at = np.flatnonzero(segment == s)
                for i in at[own[s][first[at]] & own[s][second[at]]]:
                    counts[keys[i]] += 1
                    met = owner.get(keys[i])
                    owner[keys[i]] = ids[i] if met is None else met if ids[i] is None else min(met, ids[i])
        if counts:
            keys = list(counts)
            for k in range(0, len(keys), 10_000):
                some = keys[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([xxhash.xxh3_128_digest(x) for x in some], pa.binary()), pa.array([counts[x] for x in some], pa.int64()), pa.array([owner[x] for x in some], pa.int64())], names=["key", "digest", "n", "owner"])

    return texts.mapInArrow(look, "key binary, digest binary, n long, owner long")


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, filter_mb: float = FILTER_MB, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(digest, n_docs, owner): the keys of at least `min_chars` code points that at least `min_docs` documents hold, and the smallest doc_id of those."""
    spark = docs.sparkSession
    plain = pick(docs, "text", "doc_id")
    texts = plain.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    lines = plain.select(F.sum(F.regexp_count("text", F.lit("\n")) + 1)).head()[0] or 0
    segments = max(1, -(-lines * BITS_PER_KEY // segment_bits))
    filters = materialise(twice_seen(texts, segments, segment_bits), "twice-seen")
    per_slice = max(1, int(filter_mb * 8 * (1 << 20)) // segment_bits)
    parts = []
    for low in range(0, segments, per_slice):
        own = filters.filter((F.col("segment") >= low) & (F.col("segment") < low + per_slice)).select("segment", "places").collect()
        bits = {}
        for row in own:
            whole = np.zeros(segment_bits, bool)
            whole[_unpack(row["places"])] = True
            bits[row["segment"]] = zlib.compress(np.packbits(whole, bitorder="little").tobytes(), 1)
        parts.append(_suspects(texts, segments, segment_bits, bits))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    counted = found.groupBy("key", "digest").agg(F.sum("n").alias("n_docs"), F.min("owner").alias("owner"))
    return counted.filter((F.col("n_docs") >= min_docs) & (F.length(F.col("key").cast("string")) >= min_chars)).select("digest", "n_docs", "owner")


def _cut(text: bytes | None, doomed, doc_id: int | None = None) -> tuple[int, int, bytes]:
    """Lines, lines dropped, and the text left.  doomed: digest -> the document in which the first such line stays, or None."""
    lines = (text or b"").split(b"\n")
    digest = xxhash.xxh3_128_digest
    kept, met = [], set()
    for line in lines:
        key = line_key(line)
        name = digest(key) if key else b""
        if name in doomed and (doomed[name] is None or doomed[name] != doc_id or name in met):
            continue
        met.add(name)
        kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


RESULT = "doc_id {kind}, n_lines long, n_dropped long, kept binary"


def drop_repeated_lines(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS, keep_first: bool = False, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each text without the repeated lines, as UTF-8 bytes.

    keep_first: the first such line of the smallest doc_id that holds it stays.
    """
    df = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = RESULT.format(kind=kind)
    owner = F.col("owner") if keep_first else F.lit(None).cast("long")
    hot = materialise(repeated_keys(docs, **options).select("digest", owner.alias("owner")), "repeated-keys")

    def rows(batch: pa.RecordBatch, doomed: list) -> pa.RecordBatch:
        cut = [_cut(t, d, i) for i, t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), doomed, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.binary())],
            names=["doc_id", "n_lines", "n_dropped", "kept"],
        )

    if hot.count() <= broadcast_keys:
        sent = docs.sparkSession.sparkContext.broadcast({bytes(r[0]): r[1] for r in hot.toLocalIterator()})

        def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, [sent.value] * batch.num_rows)

        return df.mapInArrow(cut_all, schema)

    marked = df.withColumn("__h", F.xxhash64("text"))

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[xxhash.xxh3_128_digest(k) for k in keys] for keys in _document_keys(batch.column(1).to_pylist())]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([d for x in own for d in x], pa.binary())], names=["d", "h", "digest"])

    held = marked.mapInArrow(own_keys, f"d {kind}, h long, digest binary").join(hot, "digest")
    doomed = held.groupBy("d", "h").agg(F.collect_set(F.struct("digest", "owner")).alias("doomed"))
    joined = marked.join(doomed, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("__h").eqNullSafe(F.col("h")), "left").select("doc_id", "text", "doomed")

    def cut_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch, [{x["digest"]: x["owner"] for x in own or ()} for own in batch.column(2).to_pylist()])

    return joined.mapInArrow(cut_own, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, line, i, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
hot AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(hot.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.k = hot.k GROUP BY k.doc_id
"""
