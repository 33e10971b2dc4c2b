"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows (short items are one window).
A window of m characters that a text repeats with at most k edits shares at least
m + 1 - q - k * q q-grams with it there, and these lie on at most k + 1 diagonals
(place in the text less place in the window).  So the shared q-grams are counted
in overlapping diagonal bands of 2 * (k + 1), and only bands that meet the bound
are aligned, within the band alone.

Passages cut out of an item are found by their characters as they are: each stretch
of `PASSAGE` characters that an item of any length and a text share, at whatever
places, is a hit, and the region is the longest stretch of the text made of such.
Where a window of the item is met too, the window's region is reported.

Items of fewer than Q characters have no q-gram: they are found where they stand as they
are, as whole words.

Texts and items are compared in lower case (A-Z), each run of other ASCII characters
than digits and letters as one space.  The windows are broadcast in slices of a
bounded size, one pass over the texts for each slice.  Texts are not shuffled.  Equal
items are looked for once, whatever their number, and joined to what was found.

Defined results: null and empty texts hold nothing; null items, and those without a digit,
a letter or a character beyond ASCII, are in no text; doc_id and item_id may be of any
type and are passed through, also null; repeated rows and repeated items each give their
rows; of equally good regions the first holds; texts of any length are searched whole, in
pieces of bounded memory where many are short; further columns, whatever their names, are
carried along by `decontaminate`; empty tables give no hits.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import pick, small_batches, table

Q = 10
#: Characters of a window and between windows; hundredths of it that may differ.
WINDOW, STEP = 200, 100
EDITS = 8
#: Characters that a cut passage must have at least, a multiple of Q.
PASSAGE = 50
#: Bytes of benchmark text that one pass looks for; their index takes some 45 bytes a byte in each worker.
SLICE_BYTES = 4 << 20
CHUNK = 1 << 19
TABLE_BITS = 22

FOLD = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)
MUL = np.uint64(0x9E3779B97F4A7C15)


def normal(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes with single spaces, and where each stood."""
    folded = FOLD[raw]
    space = folded == 0x20
    keep = np.flatnonzero(~(space & np.concatenate([[True], space[:-1]])))
    return folded[keep], keep


def grams(text: np.ndarray) -> np.ndarray:
    """A 64-bit number for the q-gram at each place: its first and last eight bytes, mixed."""
    n = len(text) - 7
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    eight = np.empty(n, "<u8")
    for r in range(min(8, n)):
        part = text[r : r + (len(text) - r) // 8 * 8]
        eight[r::8] = part.view("<u8")
    both = eight[: n - Q + 8] * MUL
    return both ^ (both >> np.uint64(29)) ^ (eight[Q - 8 :] * np.uint64(0xBF58476D1CE4E5B9))


def stretches(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit number for the PASSAGE characters from each of some places, out of the q-grams side by side in them."""
    mixed = np.zeros(len(at), np.uint64)
    for k in range(0, PASSAGE, Q):
        mixed = (mixed ^ own[at + k]) * MUL
        mixed ^= mixed >> np.uint64(31)
    return mixed


def banded(pattern: np.ndarray, region: np.ndarray, width: int, first: np.ndarray | None = None) -> np.ndarray:
    """Fewest edits between the pattern and a stretch of the region that ends on each of `width` diagonals.

    The stretch may begin on any of them, at the cost given by `first` (none).
    """
    m = len(pattern)
    padded = np.zeros(m + width, np.uint8)
    padded[: min(len(region), m + width)] = region[: m + width]
    steps = np.arange(width, dtype=np.int32)
    row = np.zeros(width, np.int32) if first is None else first.astype(np.int32)
    for j in range(m):
        nxt = row + (padded[j : j + width] != pattern[j])
        nxt[:-1] = np.minimum(nxt[:-1], row[1:] + 1)
        row = np.minimum.accumulate(nxt - steps) + steps
    return row


def aligned(pattern: np.ndarray, text: np.ndarray, diagonal: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, first, after the last) of the best region of the text on 2 * (budget + 1) diagonals; None beyond the budget."""
    width, m = 2 * (budget + 1), len(pattern)
    # A band may begin before the text does: what is missing there is filled up with bytes that match nothing.
    missing = max(0, -diagonal)
    region = np.concatenate([np.zeros(missing, np.uint8), text[max(0, diagonal) : max(0, diagonal + width + m)]])
    row = banded(pattern, region, width)
    at = int(row.argmin())
    edits = int(row[at])
    if edits > budget:
        return None
    stop = min(len(text), max(1, diagonal + m + at))
    # Read backwards from there, the stretch begins where as many edits bring the whole pattern.
    before = np.concatenate([np.zeros(budget + 1, np.uint8), text[max(0, stop - m - width) : stop][::-1]])
    back = banded(pattern[::-1], before, width, np.abs(np.arange(width) - budget - 1))
    first = stop - (m + int(back.argmin()) - budget - 1)
    return edits, max(0, min(first, stop - 1)), stop


class Windows:
    """The windows of some items, with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], edits: int = EDITS):
        self.items, self.text, self.keys, self.whole = [], [], [], []
        #: Items below Q characters, by the number of their words.
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for key, raw in items:
            text, _ = normal(np.frombuffer(raw, np.uint8))
            text = text[: len(text) - 1] if len(text) and text[-1] == 0x20 else text
            if len(text) < Q:
                if len(text):
                    name = text.tobytes()
                    self.short[name.count(b" ") + 1][name].append(key)
                continue
            if len(text) >= PASSAGE:
                self.keys.append(key)
                self.whole.append(text)
            starts = list(range(0, len(text) - WINDOW, STEP)) + [max(0, len(text) - WINDOW)]
            for s in starts:
                self.items.append(key)
                self.text.append(np.ascontiguousarray(text[s : s + WINDOW]))
        size = np.array([len(t) for t in self.text], np.int64)
        self.budget = np.minimum(size * edits // 100, (size - Q) // Q)
        self.bound = np.maximum(1, size + 1 - Q - self.budget * Q)
        per = [grams(t) for t in self.text]
        flat = np.concatenate(per) if per else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.of = np.repeat(np.arange(len(per), dtype=np.int32), [len(g) for g in per])[order]
        self.at = np.concatenate([np.arange(len(g), dtype=np.int16) for g in per])[order] if per else np.zeros(0, np.int16)
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[(self.gram * MUL) >> np.uint64(64 - TABLE_BITS)] = True
        # Of a stretch that repeats within an item, one place is kept.
        per = [np.unique(stretches(grams(t), np.arange(len(t) - PASSAGE + 1)), return_index=True) for t in self.whole]
        flat = np.concatenate([h for h, _ in per]) if per else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.stretch = flat[order]
        self.stretch_of = np.repeat(np.arange(len(per), dtype=np.int32), [len(h) for h, _ in per])[order]
        self.stretch_at = np.concatenate([i for _, i in per]).astype(np.int32)[order] if per else np.zeros(0, np.int32)

    def known(self, own: np.ndarray) -> np.ndarray:
        """Whether each q-gram may be one of the items'."""
        return self.seen[(own * MUL) >> np.uint64(64 - TABLE_BITS)]

    def passages(self, own: np.ndarray, known: np.ndarray, joined: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first, after the last) of every longest stretch in a text made of an item's passages."""
        n = len(own) - PASSAGE + Q
        if n <= 0 or not len(self.stretch):
            return
        may = known[:n].copy()
        for k in range(Q, PASSAGE, Q):
            may &= known[k : k + n]
        near = np.flatnonzero(may)
        sought = stretches(own, near)
        left = np.searchsorted(self.stretch, sought)
        n = np.searchsorted(self.stretch, sought, side="right") - left
        spot = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, of = np.repeat(near, n), self.stretch_of[spot]
        order = np.lexsort((place, of))
        place, of, spot = place[order], of[order], spot[order]
        if not len(place):
            return
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)]))
        for a, b in zip(first, np.append(first[1:], len(place)), strict=True):
            item, at, start = int(of[a]), int(self.stretch_at[spot[a]]), int(place[a])
            if np.array_equal(joined[start : start + PASSAGE], self.whole[item][at : at + PASSAGE]):
                k = int(np.searchsorted(begins, start, side="right")) - 1
                yield k, item, start - int(begins[k]), int(place[b - 1]) + PASSAGE - int(begins[k])

    def bands(self, own: np.ndarray, known: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, window, first diagonal) of every band that meets the bound; own: q-grams of joined texts, which begin at `begins`."""
        near = np.flatnonzero(known)
        left = np.searchsorted(self.gram, own[near])
        right = np.searchsorted(self.gram, own[near], side="right")
        n = right - left
        near, left, n = near[n > 0], left[n > 0], n[n > 0]
        if not len(near):
            return
        spot = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, of, at = np.repeat(near, n), self.of[spot], self.at[spot]
        text = np.searchsorted(begins, place, side="right") - 1
        # Only windows that share enough q-grams with a text at all.
        pair = text * len(self.items) + of  # 64 bits, as text has
        names, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        enough = counts[inverse] >= self.bound[of]
        pair, place, of, at = pair[enough], place[enough], of[enough], at[enough]
        stride = self.budget[of] + 1
        band = (place - begins[pair // len(self.items)] - at + WINDOW) // stride
        shared = np.concatenate([np.stack([pair, band, at], 1), np.stack([pair, band - 1, at], 1)])
        shared = np.unique(shared, axis=0) if len(shared) else shared
        if not len(shared):
            return
        new = np.flatnonzero(np.concatenate([[True], (shared[1:, :2] != shared[:-1, :2]).any(axis=1)]))
        counts = np.diff(new, append=len(shared))
        for row, count in zip(shared[new], counts, strict=True):
            window = int(row[0] % len(self.items))
            if count >= self.bound[window]:
                yield int(row[0] // len(self.items)), window, int(row[1] * (self.budget[window] + 1)) - WINDOW

    @staticmethod
    def _take(own: dict[int, tuple[int, int, int]], key: int, region: tuple[int, int, int], origin: np.ndarray) -> None:
        """Keeps the better of a region of the folded text and what `own` has for the item, in bytes of the text."""
        edits, first, stop = region
        best = (edits, int(origin[first]), int(origin[stop - 1]) + 1)
        own[key] = min(best, own.get(key, best))

    def _short_hits(self, text: np.ndarray, origin: np.ndarray, own: dict[int, tuple[int, int, int]]) -> None:
        """The first place of each item below Q characters."""
        words = text.tobytes().split()
        ends = np.flatnonzero(np.concatenate([text == 0x20, [True]]) & np.concatenate([[False], text != 0x20]))
        for n, names in self.short.items():
            for i in range(len(words) - n + 1):
                name = b" ".join(words[i : i + n])
                for key in names.get(name, ()):
                    if key not in own:
                        stop = int(ends[i + n - 1])
                        self._take(own, key, (0, stop - len(name), stop), origin)

    def hits(self, texts: list[bytes]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text: item -> (edits, first byte, byte after the last) of its best region; a cut passage counts no edits."""
        found: list[dict] = [{} for _ in texts]
        if not self.items and not self.short:
            return found
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            folded = [normal(np.frombuffer(t, np.uint8)) for t in texts[at:end]]
            gap = np.zeros(Q, np.uint8)
            joined = np.concatenate([x for f, _ in folded for x in (f, gap)])
            begins = np.cumsum([0] + [len(f) + Q for f, _ in folded])[:-1]
            own_grams = grams(joined)
            known = self.known(own_grams)
            for k, window, diagonal in self.bands(own_grams, known, begins):
                text, origin = folded[k]
                best = aligned(self.text[window], text, diagonal, int(self.budget[window]))
                if best:
                    self._take(found[at + k], self.items[window], best, origin)
            for k, (text, origin) in enumerate(folded if self.short else ()):
                self._short_hits(text, origin, found[at + k])
            longest: dict[tuple[int, int], tuple[int, int]] = {}
            for k, item, first, stop in self.passages(own_grams, known, joined, begins):
                if self.keys[item] not in found[at + k]:
                    longest[k, item] = max(longest.get((k, item), (0, 0)), (stop - first, -first))
            for (k, item), (size, first) in longest.items():
                self._take(found[at + k], self.keys[item], (0, -first, size - first), folded[k][1])
            at = end
        return found


def _keyed(benchmark: DataFrame) -> DataFrame:
    """(item_id, key, text) of items with a text; equal texts have one key."""
    items = pick(benchmark, "item_id", "text").filter("text IS NOT NULL")
    return items.select("item_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """(key, text) of the items, a bounded number of bytes at a time; a hash deals them, so a slice may be somewhat larger."""
    items = _keyed(benchmark).groupBy("key").agg(F.first("text").alias("text"))
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = -(-total // SLICE_BYTES)
    for k in range(n):
        own = items if n == 1 else items.filter(F.pmod("key", F.lit(n)) == k)
        yield [(r[0], bytes(r[1])) for r in own.collect()]


#: The index that this worker built last; it outlives the task.
_BUILT: dict[str, Windows] = {}


def _windows(name: str, items: list[tuple[int, bytes]], edits: int) -> Windows:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(items, edits)
    return _BUILT[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): the best region of every item that a text holds, in code points."""
    spark = docs.sparkSession
    small_batches(spark)
    df = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key long, edits long, start long, stop long"
    out = spark.createDataFrame([], schema)
    for n, items in enumerate(_slices(benchmark)):
        sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            windows = _windows(name, sent.value, edits)
            for batch in batches:
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                rows = [(i, key, *best) for i, own in enumerate(windows.hits(texts)) for key, best in own.items()]
                point = lambda i, byte: len(texts[i][:byte].decode(errors="ignore"))
                columns = ([r[1] for r in rows], [r[2] for r in rows], [point(r[0], r[3]) for r in rows], [point(r[0], r[4]) for r in rows])
                own = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "key", "edits", "start", "stop"])

        part = df.mapInArrow(run, schema)
        out = out.union(part) if n else part
    return out.join(_keyed(benchmark).select("item_id", "key"), "key").select("doc_id", "item_id", "edits", "start", "stop")


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of docs whose texts hold no benchmark item, with their columns as they are."""
    cols = docs.columns
    small_batches(docs.sparkSession)
    spot = cols.index("text") if "text" in cols else [c.lower() for c in cols].index("text")
    df = docs.toDF(*(f"__in{i}" for i in range(len(cols))))
    for items in _slices(benchmark):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            windows = _windows(name, sent.value, edits)
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(spot).to_pylist()]
                yield batch.filter(pa.array([not own for own in windows.hits(texts)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df.toDF(*cols)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
