"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself in the order (doc_id, start). Its phrases are indexed in hash blocks
(repeats.py), and every document is looked up in all blocks that hold one of its anchors. Phrases whose
source runs on without a break are joined, greedily from the left, to the longest factors. Where factors
of different sources meet, the phrases around the boundary are not equal as a whole; there single windows
are looked up, so no repeat that crosses a boundary is lost. Factors of at least `window` words are
duplicate spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrainflow.llm.repeats import FLAG, covered, each_text_apart, read_text_block, repeated_ranges, unpack_all

WINDOW = 20
GRAM = 6
OUT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, factors array<struct<start:bigint,length:bigint,source_doc:bigint,source_start:bigint>>, kept string"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FACTOR = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())]))
ARROW_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPAN), ("factors", _FACTOR), ("kept", pa.string())])


def greedy_factors(at, n, source, source_at, window: int) -> list[dict]:
    """Join ranges that continue one another in the document and in the source; longest first from the left."""
    out: list[list[int]] = []
    for a, k, s, b in sorted(zip(at.tolist(), n.tolist(), source.tolist(), source_at.tolist(), strict=True)):
        if out and out[-1][2] == s and b - a == out[-1][3] - out[-1][0] and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + k - out[-1][0])
        else:
            out.append([a, k, s, b])
    return [{"start": a, "length": k - 1 + window, "source_doc": s, "source_start": b} for a, k, s, b in out]


def runs(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def _parse(window: int):
    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        doc, at, n, source, source_at = (c.view(np.int64) for c in unpack_all(FLAG, flags.column("payload").to_pylist()))
        order = np.lexsort((at, doc))
        doc, at, n, source, source_at = (c[order] for c in (doc, at, n, source, source_at))
        batches = []
        for payload in texts.column("payload").to_pylist():
            ids, valid, data, offsets = read_text_block(payload)
            body, rows = data.tobytes(), []
            lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
            for r in range(len(ids)):
                words = body[offsets[r] : offsets[r + 1]].split()  # bytes: splits at the six separators only
                if hi[r] > lo[r] and valid[r]:
                    s = slice(lo[r], hi[r])
                    mask = covered(len(words), at[s], n[s], window)
                    kept = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
                    rows.append((int(ids[r]), len(words), len(words) - len(kept), runs(mask), greedy_factors(at[s], n[s], source[s], source_at[s], window), b" ".join(kept)))
                else:
                    rows.append((int(ids[r]) if valid[r] else None, len(words), 0, [], [], b" ".join(words)))
            *fixed, kept = zip(*rows, strict=True)
            batches.append(pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(fixed, ARROW_OUT, strict=False)), pa.array(kept, pa.binary()).cast(pa.string())], schema=ARROW_OUT))
        return pa.Table.from_batches(batches, schema=ARROW_OUT)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word that lies in a run of `window` words whose sequence also starts earlier in the corpus.

    docs: doc_id, text; other columns are ignored. Earlier: a smaller doc_id, or an earlier start in the same
    document. Returns one row per input row: doc_id, n_words, n_removed, spans and factors (in words), kept
    (remaining words joined by one space). Null or empty text: no words. Fewer than `window` words: nothing
    removed. Null doc_id: kept as it is and never a source. Rows that repeat doc_id and text count as one document; rows
    that share a doc_id only are documents of their own, in the order of a hash of their texts.
    Empty table: empty result.
    """

    def run(rows: DataFrame) -> DataFrame:
        texts, flags, spec = repeated_ranges(rows, window, min(GRAM, window), "word", True)
        return texts.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(_parse(spec.window), OUT)

    return each_text_apart(docs, run)
