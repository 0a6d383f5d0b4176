"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its text is trained on.
A conversation that does not end with an assistant turn has one more example without a target, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
BEGIN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Put one more backslash into every `<`, backslashes, `|`, so that no text holds the start of a mark."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own: backslashes and line feeds are spelled out as well."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\-"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> one row per example: conv_id, example, n_context, text, loss_start, loss_end.

    Turns are ordered by turn, then role and text, so ties and repeated rows have a fixed order; a null turn comes
    first. Null role or text: empty. Null conv_id: one conversation of its own. example counts from 0 in a
    conversation; loss_start and loss_end are code points of text, equal where nothing is trained on. Other columns are
    ignored. Empty table: empty result. An example holds its whole context, so a conversation must fit a row.
    """
    turns = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    heads = F.transform("rows", lambda r: F.concat(F.lit(BEGIN), escape_role(r.role), F.lit("\n")))
    bodies = F.transform("rows", lambda r: escape(r.text))
    targets = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: (F.element_at("rows", i).role == "assistant") | (i == F.size("rows")))
    whole = whole.select("conv_id", "rows", heads.alias("heads"), bodies.alias("bodies"), targets.alias("targets"))
    rendered = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE + "\n")))
    each = whole.select("conv_id", "rows", "heads", "bodies", rendered.alias("rendered"), F.posexplode("targets").alias("example", "at"))
    context = F.array_join(F.slice("rendered", F.lit(1), F.col("at") - 1), "")
    each = each.select("conv_id", "example", "at", context.alias("context"), F.element_at("heads", F.col("at")).alias("head"), F.element_at("bodies", F.col("at")).alias("body"), (F.element_at("rows", F.col("at")).role == "assistant").alias("trained"))
    start = F.length("context") + F.length("head")
    return each.select(
        "conv_id",
        F.col("example").cast("bigint").alias("example"),
        (F.col("at") - 1).cast("bigint").alias("n_context"),
        F.concat("context", "head", "body", F.lit(CLOSE + "\n")).alias("text"),
        start.cast("bigint").alias("loss_start"),
        F.when(F.col("trained"), start + F.length("body")).otherwise(start).cast("bigint").alias("loss_end"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.split(text, r"<\|im_end\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    after = F.transform(parts, lambda p: F.substring(p, F.lit(len(BEGIN) + 1), F.length(p)))
    return F.transform(
        after,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted examples alone."""
    loss = F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.array_sort(F.collect_list(F.struct("example", unescape(loss).alias("loss")))).alias("losses"),
        F.sum(F.length("text")).cast("bigint").alias("formatted_chars"),
        F.count("*").cast("bigint").alias("n_examples"),
    )
    per = per.select("conv_id", "formatted_chars", "n_examples", read_back(F.col("last")).alias("turns"), F.array_join(F.transform("losses", lambda x: x.loss), "").alias("loss"))
    return per.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
