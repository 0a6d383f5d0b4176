"""Where do strings of a fixed number of units (words or bytes) occur earlier in the corpus?

Shared by the substring deduplicators. All rows that cross a shuffle are packed blocks:

1. Every task cuts its documents into phrases. The starts of consecutive windows that choose the same
   anchor (their smallest hashed gram) form a phrase, so equal windows always fall into phrases with equal anchors.
   A phrase is named by its anchor and by its content. Copies inside one task are settled there
   and only their first occurrence travels, so a common passage sends one row a task, not one a document.
2. Phrases meet by anchor. Where an anchor has one content only, all later phrases are repeats.
3. Where it has several contents, a window that two of them share holds the anchor and one more stretch of equal
   units to its left or right. The bucket is refined by the identifiers of those two stretches; windows of phrases that
   still are not alone are looked up one by one in a second, small round.

Documents meet their answers by a hash of the identifier; texts travel compressed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm.common import byte_ids, join_ids, mix, shared_checkpoint, shuffle_partitions, text_batches, word_ids, word_spans
from terrainflow.llm.merkle import numbered

PROBE, FLAG, REQUEST, TEXT = 0, 1, 2, 3
#: Bytes kept of each column of a block.
WIDTHS = {PROBE: (5, 5, 8, 4, 1, 1, 2, 2), FLAG: (8, 4, 1, 8, 4), REQUEST: (8, 4, 1)}
ROWS = "bucket int, kind int, payload binary"
ARROW_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Text bytes after which a task settles and sends what it has gathered.
FLUSH = {"word": 32 << 20, "byte": 12 << 20}
#: Windows after which a task of the second round does.
FLUSH_WINDOWS = 500_000


@dataclass(frozen=True)
class Repeats:
    """window and gram in units; same_document: an earlier start in the same document counts too.

    left: a window either has that many units before its anchor, or `right` units after it.
    """

    window: int
    gram: int
    unit: str
    same_document: bool
    buckets: int

    @property
    def left(self) -> int:
        return max(1, (self.window - self.gram) // 2)

    @property
    def right(self) -> int:
        return max(1, self.window - self.gram - self.left + 1)


def pack(kind: int, columns) -> bytes:
    planes = [np.ascontiguousarray(c).astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, WIDTHS[kind], strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(kind: int, payload: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n, at, out = len(data) // sum(WIDTHS[kind]), 0, []
    for w in WIDTHS[kind]:
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = data[at : at + n * w].reshape(w, n).T
        out.append(full.view(np.uint64).ravel())
        at += n * w
    return out


def unpack_all(kind: int, payloads) -> list[np.ndarray]:
    parts = [unpack(kind, p) for p in payloads]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64) for _ in WIDTHS[kind]]


def document_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _blocks(kind: int, bucket: np.ndarray, columns):
    """One packed block for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(bucket)], strict=True):
        if hi > lo:
            yield int(bucket[lo]), kind, pack(kind, [c[lo:hi] for c in columns])


def _rows(items, every: int = 256):
    held = []
    for item in items:
        held.append(item)
        if len(held) == every:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW_ROWS, strict=True)], schema=ARROW_ROWS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW_ROWS, strict=True)], schema=ARROW_ROWS)


def units(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """A value for each unit and, for each document, the index of its first unit."""
    if unit == "byte":
        return byte_ids(data), offsets
    starts, ends, first = word_spans(data, offsets)
    return word_ids(data, starts, ends), first


def string_ids(values: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Identifiers of the strings of each length at every unit.

    The identifier of twice the length comes from the identifiers at a position and at a later offset, so each
    level is used again by the next. They depend on content only: every task names a string alike.
    """
    levels, out, size = {1: values}, [], 1
    while 2 * size <= max(lengths):
        level = levels[size]
        levels[2 * size] = join_ids(level[:-size], level[size:]) if len(level) > size else level[:0]
        size *= 2
    for length in lengths:
        base = max(s for s in levels if s <= length)
        level, shift = levels[base], length - base
        out.append(level if not shift else join_ids(level[:-shift], level[shift:]) if len(level) > shift else level[:0])
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i for which it is complete."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = np.full(-(-len(values) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def phrases(values: np.ndarray, first: np.ndarray, spec: Repeats):
    """Of every phrase: anchor, content, document index, start in the document, number of windows, units from the start to
    the anchor, and 16-bit identifiers of the stretches left and right of the anchor (0: no window needs it)."""
    counts = np.maximum(np.diff(first) - spec.window + 1, 0)
    total = int(counts.sum())
    if not total:
        return None
    grams, windows, lefts, rights = string_ids(values, spec.gram, spec.window, spec.left, spec.right)
    bits = np.uint64(len(grams).bit_length())
    ranked = (mix(grams) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    lowest = sliding_minimum(ranked, spec.window - spec.gram + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = first[:-1][doc] + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = (lowest[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.ones(total, bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(begins)
    b = np.append(a[1:], total) - 1
    n = (b - a + 1).astype(np.uint64)
    content = join_ids(join_ids(windows[start[a]], windows[start[b]]), n)
    at, lead = start[a], anchor[a] - start[a]
    left, right = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    use = lead >= spec.left
    left[use] = np.maximum(lefts[anchor[a][use] - spec.left] >> np.uint64(13) & np.uint64(0xFFFF), np.uint64(1))
    use = anchor[a] - start[b] < spec.left
    right[use] = np.maximum(rights[anchor[a][use] + spec.gram] >> np.uint64(13) & np.uint64(0xFFFF), np.uint64(1))
    return grams[anchor[a]], content, doc[a], at - first[:-1][doc[a]], n, lead.astype(np.uint64), left, right


def _settle(columns, spec: Repeats):
    """Order by (key, content, document, start); which entries repeat the first of their class; index of that first."""
    order = np.lexsort((columns[3], columns[2].view(np.int64), columns[1], columns[0]))
    columns = [c[order] for c in columns]
    key, content, doc, at = columns[:4]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    later = doc != doc[lead]
    if spec.same_document:
        later |= at != at[lead]
    return columns, later, lead


def _send(parts, spec: Repeats):
    """Settle what one task has gathered, then blocks: flags to documents, the rest to its anchor's bucket."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    columns, later, lead = _settle(columns, spec)
    key, _, doc, at, n = columns[:5]
    yield from _blocks(FLAG, document_bucket(doc[later], spec.buckets), [doc[later], at[later], n[later], doc[lead[later]], at[lead[later]]])
    keep = ~later
    if spec.same_document:  # a repeated row meets itself: one is enough
        keep &= (lead == np.arange(len(lead)))
    bucket = ((key[keep] >> np.uint64(40)) % np.uint64(spec.buckets)).astype(np.int64)
    yield from _blocks(PROBE, bucket, [c[keep] for c in columns])


def _phrase_blocks(spec: Repeats):
    def run(batches):
        parts, held = [], 0

        def items():
            nonlocal parts, held
            for batch, lo, hi, data, offsets in text_batches(batches, 1 << 19):
                known = batch.column(0).slice(lo, hi - lo)
                ids = np.asarray(known.fill_null(0)).view(np.uint64)
                values, first = units(data, offsets, spec.unit)
                found = phrases(values, first, spec)
                held += len(data)
                if found is not None:
                    key, content, doc, at, *rest = found
                    use = np.asarray(known.is_valid())[doc]
                    parts.append([key[use], content[use], ids[doc[use]], at[use].astype(np.uint64), *(c[use] for c in rest)])
                if held >= FLUSH[spec.unit] and parts:
                    yield from _send(parts, spec)
                    parts, held = [], 0
            if parts:
                yield from _send(parts, spec)

        yield from _rows(items())

    return run


def _not_alone(ids: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    _, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _resolve(spec: Repeats):
    """Of one bucket of anchors: flags, and requests for the phrases whose anchor has several contents."""

    def run(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        payloads = table.column("payload").to_pylist()
        passed = [(b, FLAG, p) for b, k, p in zip(table.column("bucket").to_pylist(), kinds, payloads, strict=True) if k == FLAG]
        out = list(passed)
        columns = unpack_all(PROBE, [p for k, p in zip(kinds, payloads, strict=True) if k == PROBE])
        if len(columns[0]):
            columns, later, lead = _settle(columns, spec)
            key, content, doc, at, n, ahead, left, right = columns
            out += _blocks(FLAG, document_bucket(doc[later], spec.buckets), [doc[later], at[later], n[later], doc[lead[later]], at[lead[later]]])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            edges = np.flatnonzero(new)
            mixed = np.minimum.reduceat(content, edges) != np.maximum.reduceat(content, edges)
            mixed = np.repeat(mixed, np.diff(np.append(edges, len(key)))) & ~later
            split = np.maximum(ahead.astype(np.int64) - spec.left + 1, 0).astype(np.uint64)  # windows with a left stretch
            for side, begin, count in ((left, np.zeros_like(n), np.minimum(split, n)), (right, np.minimum(split, n), n - np.minimum(split, n))):
                ask = np.flatnonzero(mixed & (side > 0) & (count > 0))
                ask = ask[_not_alone(join_ids(key[ask], side[ask]))]
                out += _blocks(REQUEST, document_bucket(doc[ask], spec.buckets), [doc[ask], at[ask] + begin[ask], count[ask]])
        return pa.Table.from_batches(_rows(out), schema=ARROW_ROWS)

    return run


def _text_blocks(spec: Repeats):
    """Texts of a task by document bucket, compressed together. Rows without an identifier are marked."""

    def run(batches):
        def items():
            for batch, lo, hi, data, offsets in text_batches(batches, 4 << 20):
                known = batch.column(0).slice(lo, hi - lo)
                ids = np.asarray(known.fill_null(0)).view(np.uint64)
                valid = np.asarray(known.is_valid())
                bucket = document_bucket(ids, spec.buckets)
                body = data.tobytes()
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order])) + 1
                for rows in np.split(order, edges):
                    if len(rows):
                        head = np.concatenate([[len(rows)], ids[rows].view(np.int64), valid[rows].astype(np.int64), np.diff(offsets)[rows]]).astype(np.int64)
                        raw = head.tobytes() + b"".join(body[offsets[r] : offsets[r + 1]] for r in rows)
                        yield int(bucket[rows[0]]), TEXT, zstandard.ZstdCompressor(level=3).compress(raw)

        yield from _rows(items(), 64)

    return run


def read_text_block(payload: bytes):
    """Identifiers, whether each is known, text bytes end to end, offsets."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, valid, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    return ids, valid.astype(bool), np.frombuffer(raw, np.uint8, offset=8 + 24 * n), np.concatenate([[0], np.cumsum(sizes)])


def _window_blocks(spec: Repeats):
    """Windows of the requested phrases, as phrases of one window each."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        doc, at, n = unpack_all(REQUEST, asked.column("payload").to_pylist())
        order = np.argsort(doc, kind="stable")
        doc, at, n = doc[order], at[order], n[order]
        parts, out, held = [], [], 0
        for payload in texts.column("payload").to_pylist() if len(doc) else ():
            ids, valid, data, offsets = read_text_block(payload)
            lo, hi = np.searchsorted(doc, ids.view(np.uint64)), np.searchsorted(doc, ids.view(np.uint64), "right")
            for r in np.flatnonzero((hi > lo) & valid):
                values, first = units(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]), spec.unit)
                windows = string_ids(values, spec.window)[0]
                starts, counts = at[lo[r] : hi[r]].astype(np.int64), n[lo[r] : hi[r]].astype(np.int64)
                each = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                each = each[each < len(windows)]
                none = np.zeros(len(each), np.uint64)
                # The key travels as its 40 lower bits; the content has the upper ones, so windows are told by all 64.
                parts.append([windows[each], windows[each] >> np.uint64(24), np.full(len(each), ids.view(np.uint64)[r]), each.astype(np.uint64), none + np.uint64(1), none, none, none])
                held += len(each)
                if held >= FLUSH_WINDOWS:
                    out += _send(parts, spec)
                    parts, held = [], 0
        if parts:
            out += _send(parts, spec)
        return pa.Table.from_batches(_rows(out), schema=ARROW_ROWS)

    return run


def each_text_apart(docs: DataFrame, run) -> DataFrame:
    """run(docs (doc_id, text)), whose rows carry doc_id, where rows that share a doc_id, but not the text, are documents of their own.

    They stand one after another, in the order of a hash of their texts. run tells documents by doc_id alone, so where any
    doc_id has several texts, documents get numbers in the order (doc_id, hash) for it; else the doc_ids serve as they are.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = docs.withColumn("_hash", F.xxhash64("text"))
    known = told.where("doc_id is not null").select("doc_id", "_hash")
    if known.groupBy("doc_id").agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi")).where("lo <> hi").isEmpty():
        return run(docs)
    numbers, _ = numbered(known.distinct().withColumn("tree", F.lit("")), ["doc_id", "_hash"])
    numbers = shared_checkpoint(numbers.select("doc_id", "_hash", F.col("idx").cast("bigint").alias("_number")))
    out = run(told.join(numbers, ["doc_id", "_hash"], "left").select(F.col("_number").alias("doc_id"), "text"))
    named = numbers.select(F.col("_number").alias("doc_id"), F.col("doc_id").alias("_doc"))
    return out.join(named, "doc_id", "left").withColumn("doc_id", F.col("_doc")).select(*out.columns)


def repeated_ranges(docs: DataFrame, window: int, gram: int, unit: str, same_document: bool):
    """(texts, flags, spec): packed texts and packed ranges of repeats, both by document bucket.

    docs has doc_id (bigint; null: never a source, never flagged) and text (null: empty). Rows that share a
    doc_id are taken for one document: none is a repeat of the other (each_text_apart sees to it that they have one text).
    """
    spec = Repeats(window, gram, unit, same_document, shuffle_partitions(docs.sparkSession))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = shared_checkpoint(docs.mapInArrow(_phrase_blocks(spec), ROWS).groupBy("bucket").applyInArrow(_resolve(spec), ROWS))
    texts = docs.mapInArrow(_text_blocks(spec), ROWS)
    asked = first.where(F.col("kind") == REQUEST)
    windows = texts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_window_blocks(spec), ROWS)
    second = windows.groupBy("bucket").applyInArrow(_resolve(spec), ROWS)
    flags = first.where(F.col("kind") == FLAG).unionByName(second.where(F.col("kind") == FLAG))
    return texts, flags, spec


def covered(size: int, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of size units lie in a window that starts in one of the ranges [at, at + n)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.minimum(at, size), 1)
    np.add.at(steps, np.minimum(at + n - 1 + window, size), -1)
    return np.cumsum(steps[:-1]) > 0
