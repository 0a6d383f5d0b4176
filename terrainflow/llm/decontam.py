"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

A mask selects some of the words of a short stretch and ignores the others; its hash is the same for two stretches
that differ in ignored words only. The hashes of every position of every document meet those of the benchmark, which
are sent to the tasks in blocks of bounded size, so no key is gathered anywhere. Each hit is verified on its diagonal:
some WINDOW words around it (the whole item, if shorter) must agree in at least SIMILARITY of the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SIMILARITY = 0.8
# Masks by number of words of a window (the whole item, if shorter than WINDOW). Whatever words a window of
# that size may differ in at SIMILARITY (two of 10 to 13, one of 5 to 9), one of its masks lies somewhere in the window
# without selecting any of them; a test goes through all cases. Windows under five words must be equal as a whole.
MASKS = {
    13: ("11101111", "1110100111", "1101001010011"),
    12: ("11101011", "101100111", "1111011"),
    11: ("111100011", "1101111", "1100011011"),
    10: ("111011", "11010011", "11111"),
    9: ("1111011", "1101111"),
    8: ("111011", "110111"),
    7: ("11111", "111011", "110111"),
    6: ("1111", "11011"),
    5: ("1111", "11101", "11011", "10111"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
#: Seeds of the benchmark that are sent to every task at once (about 50 bytes each); more go in several blocks by hash.
SENT_SEEDS = 1_000_000
#: Words of all items up to which they are sent to every task.
SENT_WORDS = 2_000_000


def word_hashes(text: Column, ends: bool = True) -> Column:
    """Hashes of the lower-case words (letters and digits) of a text, in order. ends: without the empty word before or after."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != "") if ends else words, lambda w: F.xxhash64(w))


def _seed(words: str, at: str, mask: str, number: int) -> Column:
    """Hash of the selected words from position `at` (from 0); null where the mask runs over the end."""
    chosen = [F.get(F.col(words), F.col(at) + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(F.col(at) + len(mask) <= F.size(words), F.xxhash64(F.lit(number), *chosen))


def seeds_of(table: DataFrame, words: str, masks: list[tuple[int, str]], keep: list[str]) -> DataFrame:
    """One row per position and mask: keep, at, window, span, hash. masks: (words of a window, mask)."""
    # A filter on the size would be pushed below the projection that makes the words, which would then be made twice.
    last = F.size(words) - min(len(m) for _, m in masks)
    placed = table.select(*keep, words, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    each = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(len(m)).alias("span"), _seed(words, "at", m, k).alias("hash")) for k, (n, m) in enumerate(masks)])
    return placed.select(*keep, words, "at", F.explode(each).alias("s")).select(*keep, words, "at", "s.window", "s.span", "s.hash").where("hash is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = 1) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row per document and item that overlap.

    Columns: doc_id, item_id, similarity (share of equal words in the best window), doc_start (word at which the item
    would begin; may be negative), n_words (of the item). similarity: SIMILARITY or more, which the masks are made for.
    Items with the same words are one, named by the smallest item_id (null if there is no other). Items without a word,
    or with fewer than least_words, are not searched. Null texts: empty, without hits. Null doc_id: one document of that
    name. Repeated rows and ties: one row per document and item. Empty tables: empty result. Other columns are ignored.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the masks find windows of similarity {SIMILARITY} and more")
    # A separator at the start of a text leaves an empty word there, which no item holds and doc_start doesn't count.
    lead = F.coalesce(F.substring(F.col("text").cast("string"), 1, 1).rlike(r"[^\p{L}\p{N}]"), F.lit(False)).cast("int")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lead.alias("lead"), word_hashes(F.col("text").cast("string"), False).alias("words"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("item")).where(F.size("item") >= max(1, least_words))
    items = items.groupBy("item").agg(F.min("item_id").alias("item_id")).withColumn("item_key", F.xxhash64("item", F.size("item")))
    found = items.groupBy(F.least(F.lit(WINDOW), F.size("item")).alias("n")).agg(F.sum(F.size("item")).alias("words")).collect()  # at most WINDOW rows
    masks = [(r.n, m) for r in sorted(found) for m in MASKS[r.n]] or [(WINDOW, m) for m in MASKS[WINDOW]]
    theirs = seeds_of(items, "item", masks, ["item_key"]).where(F.col("window") == F.least(F.lit(WINDOW), F.size("item"))).select("item_key", F.col("at").alias("item_at"), "hash")
    # What a hit needs of its document: the words around it, not the whole array.
    near_at = F.greatest(F.col("at") - WINDOW, F.lit(0))
    near = [near_at.alias("near_at"), F.slice("words", near_at + 1, 2 * WINDOW).alias("near")]
    ours = seeds_of(docs, "words", masks, ["doc_id", "lead"])
    blocks, hits = max(1, -(-sum(r.words * len(MASKS[r.n]) for r in found) // SENT_SEEDS)), None
    for k in range(blocks):
        part = theirs.where(F.pmod("hash", F.lit(blocks)) == k) if blocks > 1 else theirs
        met = ours.join(F.broadcast(part), "hash").select("doc_id", "lead", "item_key", "item_at", "span", "at", *near)
        hits = met if hits is None else hits.unionByName(met)
    hits = hits.join(F.broadcast(items) if sum(r.words for r in found) <= SENT_WORDS else items, "item_key")

    diagonal = F.col("at") - F.col("item_at")  # word of the document at which the item would begin
    size = F.least(F.lit(WINDOW), F.size("item"))
    low = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - size)
    high = F.least(F.size("item"), F.col("item_at") + size) - 1

    def same(j):
        k = j + diagonal - F.col("near_at")
        return F.coalesce((F.get("item", j) == F.when((k >= 0) & (k < F.size("near")), F.get("near", k))).cast("int"), F.lit(0))

    equal = F.transform(F.sequence(low, high), same)
    checked = hits.select("doc_id", "item_id", "item_key", (diagonal - F.col("lead")).alias("doc_start"), F.size("item").alias("n_words"), size.alias("size"), equal.alias("equal"))
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("size") + 1), lambda k: F.aggregate(F.slice("equal", k, F.col("size")), F.lit(0), lambda a, b: a + b))
    checked = checked.select("doc_id", "item_id", "item_key", "doc_start", "n_words", (F.array_max(sums) / F.col("size")).alias("similarity"))
    # The threshold comes after the maximum: before it, the filter would move into the join and keep whole documents in its rows.
    good = F.col("similarity") >= similarity
    best = checked.groupBy("doc_id", "item_key").agg(F.min("item_id").alias("item_id"), F.max("similarity").alias("similarity"), F.min(F.when(good, F.col("doc_start"))).cast("bigint").alias("doc_start"), F.max("n_words").cast("bigint").alias("n_words"))
    return best.where(good).drop("item_key")
