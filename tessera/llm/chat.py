"""Chat formatting with DataFrame expressions only, and reading the turns back.

A conversation becomes one string. A block of adjacent turns of one role is

    <|im_start|>role \n text <|im_sep|> text ... <|im_end|> \n

(without the blanks around the marks). All marks begin with `<|`. Inside roles and texts each
run `<`, backslashes, `|` gets one backslash more, so no mark can appear in them, and taking one
away gives the text back. A line break in a role, which would end the head, is written as the mark
<|im_nl|>. The mark between merged turns keeps them apart for reading back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, BREAK = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_nl|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def chat_format(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation of turns.

    loss_spans: array of (begin, length) in code points, the parts of `formatted` under the loss
    mask: the escaped texts of loss_role, marks excluded, without empty texts. Rows go by turn;
    ties by role, then text; a null turn comes first. A null role or text is empty. Repeated rows
    are turns of their own. Rows with a null conversation id form one conversation with a null id.
    Other columns are ignored; an empty table gives an empty result. Only what one conversation
    holds is gathered, since it is one output value.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Segments: (body, is it under the mask); a turn that goes on with the role before it adds SEP.
    marked = F.transform(
        "ts",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            escaped(t["text"]).alias("body"),
            F.coalesce(t["role"] == F.get(F.col("ts"), i - 1)["role"], F.lit(False)).alias("more"),
        ),
    )
    first = F.transform(
        "ms",
        lambda m, i: F.struct(
            F.when(m["more"], F.lit(SEP)).otherwise(
                F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(START), F.replace(escaped(m["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
            ).alias("head"),
            m["body"].alias("body"),
            (m["role"] == loss_role).alias("loss"),
        ),
    )
    parts = sorted_turns.select("conv_id", marked.alias("ms")).select("conv_id", first.alias("ps"))
    step = "struct(a.at + length(p.head) + length(p.body) AS at, IF(p.loss AND p.body <> '', array_append(a.spans, struct(a.at + length(p.head) AS begin, length(p.body) AS length)), a.spans) AS spans)"
    start = "struct(0 AS at, CAST(array() AS ARRAY<STRUCT<begin: INT, length: INT>>) AS spans)"
    return parts.select(
        "conv_id",
        F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END + "\n")).alias("formatted"),
        F.expr(f"aggregate(ps, {start}, (a, p) -> {step}, a -> a.spans)").alias("loss_spans"),
    )


def chat_parse(formatted: DataFrame) -> DataFrame:
    """formatted with `turns`: array of (role, text), read back from the string alone."""
    ends = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            ends,
            lambda b: F.transform(
                F.split(F.regexp_replace(b, r"^<\|im_start\|>[^\n]*\n", ""), r"<\|im_sep\|>"),
                lambda x: F.struct(
                    unescaped(F.replace(F.regexp_extract(b, r"^<\|im_start\|>([^\n]*)\n", 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
                    unescaped(x).alias("text"),
                ),
            ),
        )
    )
    return formatted.withColumn("turns", turns)
