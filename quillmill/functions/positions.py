"""Places in texts: bytes of lines and columns, and where the parts of inline markup end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.arrays import running
from quillmill.functions.text import once


def line_index(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), start, end, content: each line's place in the bytes of its text, without its line end.

    What follows the last line end is a line, though it be empty; so is an empty or null text. A carriage return belongs
    to the line end only before a line feed.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=\n)"), lambda x: F.struct(x.alias("text")))
    placed = running(lines, "text:string", lambda x: F.octet_length(x["text"]), lambda a, b: a + b)
    rows = texts.select(key, F.posexplode(placed).alias("k", "x"))
    content = F.regexp_replace(F.col("x")["item"]["text"], r"\r?\n\z", "").cast("binary")
    rows = rows.select(key, (F.col("k") + 1).cast("long").alias("line"), F.col("x")["before"].cast("long").alias("start"), content.alias("content"))
    return rows.select(key, "line", "start", (F.col("start") + F.octet_length("content")).alias("end"), "content")


def byte_offsets(places: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """places (key, line, column, after) with `offset`: the byte before, or after, the column-th byte of a line.

    Lines and columns count from 1. It is null for a line or column that isn't there, and inside a character.
    """
    width = F.col("column") - F.when(F.col("after"), 0).otherwise(1)
    inside = F.substring(F.col("content"), (width + 1).cast("int"), F.lit(1))
    whole = (F.octet_length(inside) == 0) | (inside < F.lit(b"\x80")) | (inside > F.lit(b"\xbf"))
    found = places.join(index.select(key, "line", "start", "end", "content"), [key, "line"], "left")
    return found.select(*places.columns, F.when((F.col("column") > 0) & (F.col("start") + width <= F.col("end")) & whole, F.col("start") + width).alias("offset"))


#: A text up to the bracket that closes its first one, with at most two levels of brackets inside.
_LABEL = r"^([^\[\]]*+\[(?:[^\[\]]++|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\])*+\])"


def label_end(raw: Column) -> Column:
    """The place (from 0) of the bracket that closes the first one; null if none does, or one closes before any opens.

    A backslash takes the next character's meaning. Labels with few levels are found by a pattern, which no length makes
    slow; others by a depth and a place, in steps from bracket to bracket.
    """

    def found(plain: Column) -> Column:
        label = F.regexp_extract(plain, _LABEL, 1)
        return once(label, lambda x: F.when(F.length(x) > 0, F.length(x) - 1).when(F.contains(plain, F.lit("]")), by_depth(plain)))

    return once(F.when(F.contains(raw, F.lit("\\")), F.regexp_replace(raw, r"(?s)\\.", "xx")).otherwise(raw), found)


def by_depth(plain: Column) -> Column:
    """label_end of a text without escapes, however deep its brackets are: the state is a depth and a place."""
    state = "struct<depth:int,at:int,end:int>"

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + F.length(piece)
        closes = F.endswith(piece, F.lit("]"))
        end = F.when(closes & (s["depth"] == 0), F.lit(-1)).when(closes & (s["depth"] == 1), at - 1)
        depth = s["depth"] + F.when(F.endswith(piece, F.lit("[")), 1).when(closes, -1).otherwise(0)
        return F.when(s["end"].isNotNull(), s).otherwise(F.struct(depth.alias("depth"), at.alias("at"), end.alias("end")).cast(state))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end")).cast(state)
    return F.aggregate(F.split(plain, r"(?<=[\[\]])"), start, step, lambda s: F.when(s["end"] >= 0, s["end"]))


PARTS = "struct<kind:string,open:string,close:string,inner:string>"


def link_parts(raw: Column, image: bool = False) -> Column:
    """struct<kind, open, close, inner> of a Markdown link or image: its label, and what stands around it; else null."""
    head = "![" if image else "["

    def made(end: Column) -> Column:
        inner = F.substring(raw, F.lit(len(head) + 1), end - len(head))
        return F.when(end.isNotNull(), F.struct(F.lit("image" if image else "link").alias("kind"), F.lit(head).alias("open"), F.substring(raw, end + 1, F.length(raw)).alias("close"), inner.alias("inner")))

    end = label_end(F.substring(raw, len(head), F.length(raw))) + len(head) - 1
    return F.when(F.startswith(raw, F.lit(head)), once(end, made)).cast(PARTS)


def delimited_parts(raw: Column, kind: str, delimiters: list[str]) -> Column:
    """struct<kind, open, close, inner> by the first delimiter that a text both begins and ends with; null if none, or if
    the two would overlap."""
    found = F.lit(None).cast(PARTS)
    for d in reversed(delimiters):
        inner = F.substring(raw, F.lit(len(d) + 1), F.length(raw) - 2 * len(d))
        made = F.when(F.length(raw) >= 2 * len(d), F.struct(F.lit(kind).alias("kind"), F.lit(d).alias("open"), F.lit(d).alias("close"), inner.alias("inner"))).cast(PARTS)
        found = F.when(F.startswith(raw, F.lit(d)) & F.endswith(raw, F.lit(d)), made).otherwise(found)
    return found
