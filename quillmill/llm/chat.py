"""Chat formatting: preference pairs (operator 2), native.

For each pair the longest common turn prefix of the chosen and the rejected conversation is rendered once as the
prompt; what follows on each side is rendered as its completion, with the character spans that a loss mask keeps:
the texts of assistant turns. Spans count code points of the completion, end exclusive.

Turns are ordered by (turn, role, text), so ties and repeated turns have one order; null roles and texts count as empty.
If one side is a prefix of the other (or both are equal) its completion is empty and has no spans. Turns without a
conv_id form a conversation of their own. A conversation of any length is one row, as its rendering is. An empty table
gives an empty result; further columns, whatever their names, have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.arrays import running

OPEN, CLOSE, END = "<|", "|>\n", "\n"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row per conversation: key and its turns in order, array<struct<turn, role, text>>."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")


def assistant_spans(turns: Column) -> Column:
    """array<struct<start, end>> of assistant texts in the rendering."""
    width = lambda t: (F.length(head(t)) + F.length(t["text"]) + len(END)).cast("long")
    placed = running(turns, "turn:long,role:string,text:string", width, lambda a, b: a + b, "long")

    def span(x: Column) -> Column:
        start = x["before"] + F.length(head(x["item"]))
        return F.struct(start.alias("start"), (start + F.length(x["item"]["text"])).alias("end"))

    return F.transform(F.filter(placed, lambda x: x["item"]["role"] == "assistant"), span)


def format_pairs(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """pairs: key, chosen and rejected (turn arrays). A row per pair: prompt, completions, spans and turn counts."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    stop = F.array_position(same, F.lit(False))  # 1-based; 0: none, then one side is all prefix
    cut = pairs.withColumn("common", F.when(stop > 0, stop - 1).otherwise(F.least(F.size("chosen"), F.size("rejected"))).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("common") + 1, F.greatest(F.size(c) - F.col("common"), F.lit(0)))
    cut = cut.withColumns({"prefix": F.slice("chosen", 1, F.col("common")), "c": rest("chosen"), "r": rest("rejected")})
    return cut.select(
        key, F.col("common").cast("long").alias("prompt_turns"), rendered(F.col("prefix")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
        spans_text(assistant_spans(F.col("c"))).alias("chosen_mask"), spans_text(assistant_spans(F.col("r"))).alias("rejected_mask"),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def own_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from conversations alone: chosen is the conversation as it is; rejected has the text of its last assistant
    turn replaced by that of its first one (by nothing, if they are the same turn). Without an assistant turn both are equal."""
    whole = conversations(turns)
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    whole = whole.withColumn("places", places)
    last, first = F.element_at(F.col("places"), F.size("places")), F.get("places", F.lit(0))
    text = F.when(last == first, F.lit("")).otherwise(F.get("turns", first)["text"])
    swapped = F.transform("turns", lambda t, i: F.when(i == last, F.struct(t["turn"].alias("turn"), t["role"].alias("role"), text.alias("text"))).otherwise(t))
    return whole.select("conv_id", F.col("turns").alias("chosen"), F.when(F.size("places") > 0, swapped).otherwise(F.col("turns")).alias("rejected"))
