"""Secret scans: fixed patterns, and two character Markov models whose log-likelihood ratio finds random strings.

DataFrame functions only. The models are trained on all documents: what the fixed patterns match are the samples
labelled random, strings of IDENTIFIER outside of them, numbers and dates included, are the samples labelled ordinary, unless they
mix digits and letters (MIXED).
Work is linear in a text: strings are taken apart once, and positions are summed in chunks.
A model is a table of ALPHABET x ALPHABET log-probabilities, so what reaches the driver has a fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns by kind, in the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

#: Strings that the models judge, those that train the ordinary one, and the ratio (natural logarithm) above which a string is a secret.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{12,}"
#: Digits within letters or letters within digits: such an identifier is no sample of ordinary ones, as it may be random itself.
MIXED = r"[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]"
RATIO = 12.0
#: Weight of an even distribution in the model of random strings.
EVEN = 0.3
ALPHABET = 128

SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"
#: Entries whose running sum is built in one piece: arrays are copied when they grow.
CHUNK = 128
#: Steps of the search in sorted arrays, for up to 2^25 entries.
STEPS = [1 << k for k in range(24, -1, -1)]


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sums_before(sizes: Column) -> Column:
    """Of an array of ints (not empty) the sums of all entries before each one."""
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda k: F.slice(sizes, k * CHUNK + 1, F.lit(CHUNK)))
    inner = F.transform(chunks, lambda c: F.aggregate(c, start(), step))

    def joined(parts):
        before = F.aggregate(F.transform(parts, lambda x: x["at"]), start(), step)["out"]
        return F.flatten(F.zip_with(parts, before, lambda x, o: F.transform(x["out"], lambda y: y + o)))

    return _let(inner, joined)


def _below(ordered: Column, value: Column) -> Column:
    """How many entries of a sorted array are smaller than value."""
    more = lambda lo, step: F.when((lo + step <= F.size(ordered)) & (F.get(ordered, lo + step - 1) < value), lo + step).otherwise(lo)
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), more)


def _matches(text: Column, pattern: str, kind: str, rank: int, keep, finish) -> Column:
    """finish(matches) for the pattern's matches (leftmost, not overlapping) for which keep(match) holds: structs of
    start, end, rank, kind, found (the string).

    Split and extract walk over the same matches: a match starts after the pieces and matches before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else F.array().cast("array<string>")
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("found"), F.transform(values, F.length).alias("value"))

    def spans(v):
        before = _sums_before(F.transform(v, lambda s: s["gap"] + F.coalesce(F.length(s["found"]), F.lit(0))))
        placed = F.zip_with(v, before, lambda s, at: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + F.length(s["found"])).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["found"].alias("found"), s["value"].alias("value")))
        return finish(F.filter(placed, lambda s: s["found"].isNotNull() & keep(s)))

    return F.when(F.rlike(text, F.lit(pattern)), _let(steps, spans)).otherwise(F.array().cast(SPAN))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")))


def base_spans(text: Column) -> list[Column]:
    """Spans of assign, access and hex, each as array of SPAN in order."""
    every = lambda s: F.lit(True)
    return [
        _matches(text, ASSIGN, "assign", 0, lambda s: s["value"] >= ASSIGN_VALUE, _bare),
        _matches(text, ACCESS, "access", 1, every, _bare),
        _matches(text, HEX, "hex", 2, every, _bare),
    ]


def _pairs(token: Column) -> Column:
    """128 * character + next one, for all neighbours in a string of ASCII characters."""
    return _let(F.split(token, ""), lambda c: F.zip_with(F.slice(c, F.lit(1), F.length(token) - 1), F.slice(c, F.lit(2), F.length(token) - 1), lambda x, y: F.ascii(x) * ALPHABET + F.ascii(y)))


def markov_table(docs: DataFrame) -> list[float]:
    """ln p(next | character) of random strings less that of ordinary identifiers, at 128 * character + next."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = F.rlike(text, F.lit(f"{ASSIGN}|{ACCESS}|{HEX}"))
    values = F.when(has, F.concat(F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    rest = F.when(has, F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " ")).otherwise(text)
    words = F.filter(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0)), lambda w: ~F.rlike(w, F.lit(MIXED)))
    samples = docs.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), values.alias("v")), F.struct(F.lit(False).alias("random"), words.alias("v")))).alias("s"))
    pairs = samples.select("s.random", F.explode("s.v").alias("v")).select("random", F.explode(_pairs(F.col("v"))).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect():  # at most 2 * 128 * 128 rows
        counts[r.random][r.pair] = r.n
    signs = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]
    table = [0.0] * (ALPHABET * ALPHABET)
    for a in signs:
        total = {k: sum(c.get(a * ALPHABET + b, 0) for b in signs) for k, c in counts.items()}
        for b in signs:
            # ten pseudo-counts spread evenly keep unseen pairs finite; random strings may use any character, so their
            # model is mixed with an even one, unless there is no sample of them
            p = {k: (c.get(a * ALPHABET + b, 0) + 10 / len(signs)) / (total[k] + 10) for k, c in counts.items()}
            if counts[True]:
                p[True] = (1 - EVEN) * p[True] + EVEN / len(signs)
            table[a * ALPHABET + b] = math.log(p[True] / p[False]) if counts[True] and counts[False] else 0.0
    return table


def scan_secrets(docs: DataFrame, table: list[float] | None = None, ratio: float = RATIO) -> DataFrame:
    """docs (all columns kept) -> docs with `secret_spans`: spans (start, end, rank, kind) by start and rank, code points.

    Kinds assign, access and hex are the base patterns; kind markov are strings of CANDIDATE outside of base spans whose
    log-likelihood ratio is over `ratio`. table: from markov_table, trained on docs where not given. Null text: empty.
    Rows are scanned one by one: null or repeated doc_ids and ties make no difference. Without any labelled sample
    the models are even and add nothing. Empty table: empty result. A column secret_spans of the input is replaced.
    """
    table = markov_table(docs) if table is None else table
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    model = F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")
    base = F.concat(*base_spans(text))
    found = docs.withColumn("secret_spans", base)

    def free(candidates):
        def apart(starts, ends):
            meets = lambda c: _below(starts, c["end"]) > _below(ends, c["start"] + 1)
            return _bare(F.filter(candidates, lambda c: ~meets(c) & (score(c["found"]) > ratio)))

        ordered = lambda side: F.array_sort(F.transform("secret_spans", lambda s: s[side]))
        return _let(ordered("start"), lambda starts: _let(ordered("end"), lambda ends: apart(starts, ends)))

    def score(token):
        return F.aggregate(_pairs(token), F.lit(0.0), lambda acc, pair: acc + F.get(model, pair))

    more = _matches(text, CANDIDATE, "markov", 3, lambda s: F.lit(True), free)
    return found.withColumn("secret_spans", F.array_sort(F.concat("secret_spans", more)))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with secret_spans -> docs with each stretch of overlapping spans in text replaced by mark, without secret_spans.

    Starts and ends in order say how many spans are open; a stretch lasts from where the first opens to where the last
    closes (spans that only touch are two). What lies between is cut out of the text's characters once, and joined once.
    """
    opens = F.transform("secret_spans", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("step")))
    closes = F.transform("secret_spans", lambda s: F.struct(s["end"].alias("at"), F.lit(-1).alias("step")))
    events = F.array_sort(F.concat(opens, closes))  # an end comes before a start at the same place

    def cut(es):
        told = F.arrays_zip(F.transform(es, lambda e: e["at"]).alias("at"), F.transform(es, lambda e: e["step"]).alias("step"), _sums_before(F.transform(es, lambda e: e["step"])).alias("open"))
        edge = lambda t, step, before: F.transform(F.filter(t, lambda e: (e["step"] == step) & (e["open"] == before)), lambda e: e["at"])
        between = lambda t: F.arrays_zip(F.concat(F.array(F.lit(0)), edge(t, -1, 1)).alias("lo"), F.concat(edge(t, 1, 0), F.array(F.length("text"))).alias("hi"))
        pieces = lambda t: _let(F.split("text", ""), lambda c: F.transform(between(t), lambda g: F.array_join(F.slice(c, g["lo"] + 1, g["hi"] - g["lo"]), "")))
        return F.array_join(_let(told, pieces), mark)

    clean = F.when(F.size("secret_spans") > 0, _let(events, cut)).otherwise(F.col("text"))
    return docs.withColumn("text", clean).drop("secret_spans")
