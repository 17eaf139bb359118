"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score (operator 7), native.

Positions come from the lengths of the pieces between matches, so no row-at-a-time code is needed. The patterns use
possessive repeats and look-behinds that keep the leftmost non-overlapping matches of the plain forms, but take time
and stack in proportion to the text, however long its runs are.

Base kinds (email, ip, card, phone) are always reported once their own test passes. Further kinds (iban with mod 97,
ssn, local phone) need a score of `threshold`: a kind's own score, plus what context words just before it add.

Null and empty texts have no spans. Texts are searched whole, in a time that grows little faster than text and matches.
Spans that tie at a start are told apart by their kind. Equal rows each give a row, an empty table gives an empty result,
and further columns, whatever their names, are handed through by `mask` (`pii_spans` and `_row` included).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.arrays import parted, running
from quillmill.functions.text import once

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "local_phone"]
BASE = 4
SPAN = "struct<start:int,kind_no:int,end:int,score:double>"
LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, quick test for a text that may hold one, own score, context words)
PATTERNS = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", "[0-9](?:[ -]?[0-9]){11}", 0.8, "card|visa|credit|pay|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.7, "iban|account|konto|compte|cuenta|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", 0.3, "ssn|social|security"),
    "local_phone": (r"(?<![0-9+(-])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{4}", 0.3, "phone|tel|call|mobile|fax"),
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(F.pmod(F.substr(back, i, F.lit(1)).cast("int") * 2, F.lit(9)) + F.when(F.substr(back, i, F.lit(1)) == "9", 9).otherwise(0)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the rearranged number, letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, "\\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")) <= 255))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(found, F.lit(" "), F.lit(""))).between(15, 34) & mod97(found)
    if kind == "ssn":
        return ~found.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans_of(kind: str, text: Column, threshold: float) -> Column:
    """array<struct<start, kind_no, end, score>> of one kind, in code points."""
    pattern, quick, own, words = PATTERNS[kind]
    number = KINDS.index(kind)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = once(found, lambda m: F.zip_with(m, F.slice(between, 1, F.size(m)), lambda x, s: F.struct(x.alias("m"), s.alias("s"))))
    placed = running(pairs, "m:string,s:string", lambda x: F.length(x["m"]) + F.length(x["s"]), lambda a, b: a + b)

    def span(x: Column) -> Column:
        start = x["before"] + F.length(x["item"]["s"])
        near = F.lower(F.right(x["item"]["s"], F.lit(40))).rlike(rf"\b(?:{words})")
        score = F.when(near, own + (1 - own) * 0.6).otherwise(F.lit(own))
        return F.struct(start.alias("start"), F.lit(number).alias("kind_no"), (start + F.length(x["item"]["m"])).alias("end"), score.alias("score")).cast(SPAN)

    spans = F.transform(F.filter(placed, lambda x: confirmed(kind, x["item"]["m"])), span)
    if number >= BASE:
        spans = F.filter(spans, lambda s: s["score"] >= threshold)
    may = F.contains(text, F.lit("@")) if quick == "@" else text.rlike(quick)
    return F.when(may, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame, threshold: float = 0.5, column: str = "pii_spans") -> DataFrame:
    """docs with a column of all spans by start, then kind: array<struct<start, kind_no, end, score>>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = reduce(lambda a, b: F.concat(a, b), [spans_of(k, text, threshold) for k in KINDS])
    return docs.withColumn(column, F.array_sort(every))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, and each span's score."""
    found = find(docs.select(F.col("doc_id").cast("long"), "text"), threshold).select("doc_id", "pii_spans")
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind_no"] == k)).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind_no"] < BASE)
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"), F.transform("pii_spans", lambda s: s["score"]).alias("scores"))


def mask(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every span replaced by its kind in brackets (overlapping spans by that of the first); their n_chars follows."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text").cast("string")
    found = find(docs.select(F.struct(*docs.columns).alias("_row"), text.alias("text")), threshold, "_pii")  # no name can clash
    ends = running(F.col("_pii"), SPAN[len("struct<") : -1], lambda s: s["end"], lambda a, b: F.greatest(a, b))
    kept = F.filter(ends, lambda x: x["item"]["start"] >= x["before"])

    def piece(part: Column) -> Column:
        """The text from the end of what precedes the piece's first span to the end of its last, masked."""
        low, high = F.get(part, F.lit(0))["before"], F.element_at(part, -1)["item"]["end"]
        return once(F.substr("text", low + 1, high - low), lambda t: F.array_join(F.transform(part, lambda x: F.concat(F.substr(t, x["before"] - low + 1, x["item"]["start"] - x["before"]), F.get(names, x["item"]["kind_no"]))), ""))

    masked = once(kept, lambda x: F.concat(F.array_join(F.transform(parted(x), piece), ""), F.substr("text", F.array_max(F.transform("_pii", lambda p: p["end"])) + 1, F.length("text"))))
    hit = F.size("_pii") > 0
    found = found.withColumn("_masked", F.when(hit, masked).otherwise(F.col("text")))
    new = {"text": F.col("_masked"), "n_chars": F.when(hit, F.length("_masked").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
