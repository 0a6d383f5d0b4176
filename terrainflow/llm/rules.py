"""Line-first quality rules: failing lines are taken out, then documents that lose too much text are rejected."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm.common import join_ids, mix, text_batches, word_ids, word_spans
from terrainflow.llm.repeats import string_ids

SYMBOLS = "#*$%&|<>"
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
# Phrases of lines that are boilerplate wherever they stand, in lower case.
BOILERPLATE = ("licensed under", "released under the", "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies", "javascript is disabled", "enable javascript", "sign up for our newsletter")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of what a document may lose.

    symbol_share: symbols among the visible bytes of a line. shout_share: words that end in two exclamation marks.
    capital_share: capitals among the ASCII letters of a line of at least capital_words words. separators: bars from
    which a line is navigation. most_repeated: share of words equal to the one before, in a line of at least repeated_words words.
    lost_share: share of a document's word bytes in failing lines (boilerplate lines are removed, but not counted
    as lost) from which it is rejected.
    """

    symbol_share: float = 0.08
    shout_share: float = 0.3
    capital_share: float = 0.7
    capital_words: int = 3
    separators: int = 2
    most_repeated: float = 0.3
    repeated_words: int = 20
    lost_share: float = 0.2
    min_words: int = 20
    repeat_percent: int = 30
    repeat_window: int = 8


def line_fault(line: str, rules: LineRules) -> str | None:
    """The first rule that a line with words breaks."""
    bars = line.count("|")
    if bars >= rules.separators:
        return "navigation"
    words = line.split(" ")
    n = len(words)
    symbols = bars + sum(line.count(c) for c in "#*$%&<>")
    if symbols and symbols > rules.symbol_share * (len(line) - n + 1):
        return "punctuation"
    if "!!" in line and line.count("!!") > rules.shout_share * n:
        return "punctuation"
    if n >= rules.capital_words:
        body = line.encode()
        upper = len(body) - len(body.translate(None, CAPITALS))
        if upper and upper > rules.capital_share * (upper + len(body) - len(body.translate(None, SMALL))):
            return "punctuation"
    if n >= rules.repeated_words and sum(map(str.__eq__, words, words[1:])) > rules.most_repeated * n:
        return "boilerplate"
    low = line.lower()
    if any(p in low for p in BOILERPLATE):
        return "licence"
    return None


def clean_lines(text: str, rules: LineRules) -> tuple[str, int, int, int]:
    """(remaining text, lines with words that equal an earlier one, characters of lines lost, of all lines with words)."""
    seen: set[str] = set()
    kept, repeats, lost, total = [], 0, 0, 0
    for line in text.split("\n"):
        if not line.strip(" \t\n\v\f\r"):
            kept.append(line)
            continue
        if line in seen:
            repeats += 1
        else:
            seen.add(line)
        total += len(line)
        fault = line_fault(line, rules)
        if fault is None:
            kept.append(line)
        elif fault != "licence":
            lost += len(line)
    return "\n".join(kept), repeats, lost, total


def repeated_words(ids: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Per document: words in windows that occur twice or more in it."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    total = int(counts.sum())
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    start = first[:-1][doc] + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    key = join_ids(string_ids(ids, window)[0][start], mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(total, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, start[twice], 1)
    np.add.at(steps, start[twice] + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
RESULT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_share", pa.float64()), ("clean_text", pa.string())]
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, lost_share double, clean_text string"


def _judge(rules: LineRules, with_text: bool):
    def run(batches):
        for batch, lo, hi, data, offsets in text_batches(batches):
            starts, ends, first = word_spans(data, offsets)
            ids = word_ids(data, starts, ends)
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            chars = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
            symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
            n = np.diff(first)
            repeats = repeated_words(ids, first, rules.repeat_window)
            failed = (n < rules.min_words) | (100 * repeats > rules.repeat_percent * n)
            body = data.tobytes()
            lines = [clean_lines(body[a:b].decode(), rules) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lost = np.array([x / max(t, 1) for _, _, x, t in lines], float)
            columns = [n, chars[first[1:]] - chars[first[:-1]], np.diff(symbols[offsets]), np.array([r for _, r, _, _ in lines], np.int64), repeats, failed, ~failed & (lost <= rules.lost_share), lost, [t if with_text else None for t, *_ in lines]]
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, RESULT, strict=True)]
            kept = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*kept.schema.names, *(k for k, _ in RESULT)])

    return run


def line_rules(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """docs (doc_id, text) -> doc_id, text, the columns named in extra, statistics, base_failed, kept, lost_share, clean_text, one row per input row.

    Null text: empty, so it has no words and fails. Statistics are those of the whole text; clean_text is what is left
    without failing lines (lines without words stay). kept is false where base_failed, or where more than
    rules.lost_share of the text stood in failing lines; licence lines are removed, but not held against a document.
    Rows are judged one by one: null or repeated doc_ids, ties and other columns make no difference. Empty table:
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_judge(rules, with_text), f"{fields}, {COLUMNS}")
