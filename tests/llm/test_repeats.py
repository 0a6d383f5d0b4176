import random

import numpy as np
import pyarrow as pa
import pytest

from terrainflow.llm import repeats
from terrainflow.llm.rlz import substring_dedup
from terrainflow.llm.suffixes import byte_dedup
from tests.llm.brute import byte_repeats, word_repeats

SMALL = "/root/testdata/sf0.001"


def odd_documents():
    rng = random.Random(5)
    words = ["a", "bb", "ccc", "dé", "the", "of", "x" * 30]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "of " * 400), (5, "of " * 90), (9, "é" * 300), (11, "é" * 120)]
    for i in range(20, 80):
        text = []
        for _ in range(rng.randint(1, 5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 40))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    docs += [(90 + i, docs[40][1]) for i in range(12)]
    return docs


@pytest.mark.parametrize("source", ["odd", "table"])
def test_words_against_brute_force(spark, source):
    if source == "odd":
        docs = odd_documents()
        table = spark.createDataFrame([(t, d, "x", "y") for d, t in docs], "text string, doc_id bigint, bucket string, kind string").repartition(5)
    else:
        table = spark.read.parquet(f"{SMALL}/documents.parquet")
        docs = [(r.doc_id, r.text) for r in table.collect()]
    rows = substring_dedup(table).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == word_repeats(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all((f.source_doc, f.source_start) < (r.doc_id, f.start) and f.length >= 20 for f in r.factors)


@pytest.mark.parametrize("source", ["odd", "table"])
def test_bytes_against_brute_force(spark, source):
    if source == "odd":
        docs = odd_documents()
        table = spark.createDataFrame([(t, d) for d, t in docs], "text string, doc_id bigint").repartition(5)
    else:
        table = spark.read.parquet(f"{SMALL}/documents.parquet")
        docs = [(r.doc_id, r.text) for r in table.collect()]
    rows = byte_dedup(table).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows} == byte_repeats(docs)


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id bigint, text string"
    assert substring_dedup(spark.createDataFrame([], schema)).count() == 0
    assert byte_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (None, text), (8, text)]
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(7, 0), (7, 0), (8, 40), (None, 0)]
    got = sorted(((r.doc_id, r.n_removed > 0) for r in byte_dedup(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(7, False), (7, False), (8, True), (None, False)]


@pytest.mark.parametrize("upper, repeated", [(0, 1), (1, 0)])
def test_windows_are_told_by_all_bits(monkeypatch, upper, repeated):
    """Two texts of one window each, whose identifiers agree in the lower 40 bits and, where upper is 0, in all."""
    spec = repeats.Repeats(3, 2, "byte", False, 1)
    names = iter(np.array([[7], [7 | upper << 50]], np.uint64))
    monkeypatch.setattr(repeats, "string_ids", lambda values, *lengths: [next(names)])
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": ["abc", "xyz"]})
    texts = pa.Table.from_batches(repeats._text_blocks(spec)([texts]))
    one = np.ones(2, np.uint64)
    asked = pa.Table.from_batches(repeats._rows(repeats._blocks(repeats.REQUEST, np.zeros(2, int), [np.array([1, 2], np.uint64), one - one, one])))
    found = repeats._resolve(spec)(repeats._window_blocks(spec)(texts, asked))
    flags = repeats.unpack_all(repeats.FLAG, [p for k, p in zip(found["kind"].to_pylist(), found["payload"].to_pylist(), strict=True) if k == repeats.FLAG])
    assert len(flags[0]) == repeated
