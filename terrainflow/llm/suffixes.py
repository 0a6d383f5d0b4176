"""Substring deduplication on bytes by bucket-pointer refinement of suffixes.

Suffixes fall into initial buckets by their first q bytes (q = GRAM), sampled so that every string of `window`
bytes holds a sampled one. Buckets of one suffix are finished at once. The others are refined by sorting on the
bucket identifiers of later offsets: the identifier of 2q bytes joins those of q bytes at an offset and q
further on, and each new level is reused by the next until `window` bytes are told apart (repeats.string_ids,
repeats._settle). Identifiers are functions of content, so no global ranks need to be exchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrainflow.llm.repeats import FLAG, covered, each_text_apart, read_text_block, repeated_ranges, unpack_all

WINDOW = 50
GRAM = 16
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ARROW_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPAN), ("kept", pa.binary())])


def _cut(window: int):
    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        doc, at, n, _, _ = (c.view(np.int64) for c in unpack_all(FLAG, flags.column("payload").to_pylist()))
        order = np.argsort(doc, kind="stable")
        doc, at, n = doc[order], at[order], n[order]
        batches = []
        for payload in texts.column("payload").to_pylist():
            ids, valid, data, offsets = read_text_block(payload)
            rows = []
            lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
            for r in range(len(ids)):
                text = data[offsets[r] : offsets[r + 1]]
                if hi[r] > lo[r] and valid[r]:
                    mask = covered(len(text), at[lo[r] : hi[r]], n[lo[r] : hi[r]], window)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                    rows.append((int(ids[r]), len(text), int(mask.sum()), [{"start": a, "end": b} for a, b in edges], text[~mask].tobytes()))
                else:
                    rows.append((int(ids[r]) if valid[r] else None, len(text), 0, [], text.tobytes()))
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW_OUT, strict=True)], schema=ARROW_OUT))
        return pa.Table.from_batches(batches, schema=ARROW_OUT)

    return run


def byte_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each byte covered by a string of `window` bytes that also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Returns one row per input row: doc_id, n_bytes, n_removed,
    spans (bytes, maximal), kept (remaining bytes; may cut a character). Null text: empty. Shorter than `window`:
    nothing removed. Null doc_id: kept as it is and never a source. Rows that repeat doc_id and text never
    remove from each other; rows that share a doc_id only are documents of their own, in the order of a hash of their texts. Empty table: empty result.
    """

    def run(rows: DataFrame) -> DataFrame:
        texts, flags, spec = repeated_ranges(rows, window, min(GRAM, window), "byte", False)
        return texts.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(_cut(spec.window), OUT)

    return each_text_apart(docs, run)
