import time

import pytest
from pyspark.sql import functions as F

from terrainflow.llm.decontam import contaminated
from terrainflow.llm.rlz import substring_dedup
from terrainflow.llm.secret_scan import redact, scan_secrets
from terrainflow.llm.suffixes import byte_dedup

DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize("operator", [substring_dedup, byte_dedup])
def test_rows_that_share_an_id_keep_their_own_text(spark, operator):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (None, a), (None, b), (6, None), (6, "x")]
    got = sorted(((r.doc_id, bytes(r.kept).decode() if operator is byte_dedup else r.kept) for r in operator(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, a), (5, ""), (5, b), (5, b), (7, ""), (None, a), (None, b), (6, ""), (6, "x")], key=str)


def test_doc_start_does_not_count_a_leading_separator(spark):
    words = [f"word{i}" for i in range(20)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    rows = [(1, '"' + " ".join(words) + '"'), (2, " ".join(words)), (3, "  one two " + " ".join(words)), (4, "(" + " ".join(words[3:]))]
    got = {r.doc_id: r.doc_start for r in contaminated(spark.createDataFrame(rows, DOCS), item).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: -3}


def test_redaction_of_overlapping_and_touching_spans(spark):
    rows = [(1, "abcdefghij", [(1, 3), (2, 5), (5, 6), (8, 10)]), (2, "é\U0001f600xyz", [(1, 2)]), (3, "none", []), (4, None, []), (5, "all", [(0, 3)])]
    spans = "array<struct<start:int,end:int,rank:int,kind:string>>"
    table = spark.createDataFrame([(d, t, [(a, b, 0, "hex") for a, b in s]) for d, t, s in rows], f"{DOCS}, secret_spans {spans}")
    got = {r.doc_id: r.text for r in redact(table, "#").collect()}
    assert got == {1: "a##gh#", 2: "é#xyz", 3: "none", 4: None, 5: "#"}


def test_redaction_is_linear_in_the_matches(spark):
    text = " ".join("0123456789abcdef0" for _ in range(30_000))
    docs = spark.createDataFrame([(1, text)], DOCS)
    began = time.time()
    out = redact(scan_secrets(docs, [0.0] * 128 * 128)).select(F.col("text")).first().text
    assert out == " ".join(["[SECRET]"] * 30_000)
    assert time.time() - began < 40
