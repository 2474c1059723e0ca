"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each assistant turn becomes an example of its own: all turns before it are context, and only its reply is under the
loss mask. A conversation that does not end with an assistant turn has one more example, without a target, so that the
whole conversation can be read back from the examples.

Template: ``<turn ROLE>\\nTEXT</turn>\\n`` for each turn. In a text, ``<`` + k backslashes + ``turn`` or ``/turn`` gets
one backslash more (and loses it when read), so no text can open or close a turn. In a role, ``&``, ``<`` and ``>`` are
written as ``&amp;``, ``&lt;`` and ``&gt;``.

Defined cases: a null text or role is empty; a null conversation id is a conversation; turns go by (turn, role, text),
null turns first, so ties and repeated rows have a fixed order; no rows give no examples; other columns are ignored.
A conversation is collected whole, as each of its examples is one string that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"
OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def escape_role(role: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        role = F.replace(role, F.lit(raw), F.lit(safe))
    return role


def unescape_role(role: Column) -> Column:
    for raw, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        role = F.replace(role, F.lit(safe), F.lit(raw))
    return role


def prefix_target_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = TARGET_ROLE) -> DataFrame:
    """One row per example: conv_id, example_no (from 0), n_turns, formatted, loss_start, loss_end (code points of
    `formatted`, end exclusive; both null in an example without a target)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            (t["role"] == target_role).alias("target"),
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(HEAD_END)).alias("head"),
            escape_text(t["text"]).alias("body"),
        )).alias("parts"),
    )
    parts = parts.select("conv_id", "parts", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))).alias("shown"))
    last = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("parts", i)["target"] | (i == last))
    examples = parts.select("conv_id", "parts", "shown", F.posexplode(ends).alias("example_no", "n_turns"))
    last_part = F.element_at("parts", F.col("n_turns"))
    examples = examples.select(
        "conv_id", "example_no", "n_turns", last_part.alias("part"),
        F.array_join(F.slice("shown", 1, F.col("n_turns")), "").alias("formatted"),
    )
    end = F.length("formatted") - len(CLOSE)
    return examples.select(
        "conv_id", "example_no", "n_turns", "formatted",
        F.when(F.col("part.target"), end - F.length("part.body")).alias("loss_start"),
        F.when(F.col("part.target"), end).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted example."""
    shown = F.split(formatted, CLOSE, -1)
    shown = F.slice(shown, 1, F.size(shown) - 1)

    def one(s: Column) -> Column:
        head = F.substring_index(s, HEAD_END, 1)
        return F.struct(
            unescape_role(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescape_text(F.substr(s, F.length(head) + len(HEAD_END) + 1)).alias("text"),
        )

    return F.transform(shown, one)


def target_text(formatted: Column, start: Column, end: Column) -> Column:
    """What the loss mask covers, unescaped; empty if there is no target."""
    return F.coalesce(unescape_text(F.substr(formatted, start + 1, end - start)), F.lit(""))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    each = examples.select(
        "conv_id", "example_no", "n_turns", "formatted",
        target_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), F.col("loss_end").isNotNull().cast("long").alias("target"),
    )
    by = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example_no").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example_no", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"), F.count("*").alias("n_examples"), F.sum("target").alias("n_targets"),
    )
    by = by.withColumn("turns", read_turns(F.col("longest")))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "n_targets",
    )
