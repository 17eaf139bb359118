"""Glossary files: CSV with the columns src and dst, JSON in its several shapes, and JSON inside a model's prose."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_csv(raw: bytes) -> list[tuple[str, str]]:
    """Exactly two columns named src and dst in any order; blank rows are skipped."""
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"))))
    header = [h.strip() for h in rows[0]] if rows else []
    if sorted(header) != ["dst", "src"]:
        raise ValueError("the header must be src,dst")
    out = []
    for n, row in enumerate(rows[1:], 2):
        if not any(c.strip() for c in row):
            continue
        if len(row) != 2:
            raise ValueError(f"row {n} has {len(row)} fields")
        entry = dict(zip(header, row, strict=True))
        out.append((entry["src"], entry["dst"]))
    return out


def entries(value: object) -> Iterator[tuple[str, str]]:
    """Pairs in lists at any depth, under `glossary`, as src/dst or source/target, or as a map of src to dst."""
    if isinstance(value, list):
        for x in value:
            yield from entries(x)
    elif isinstance(value, dict):
        src, dst = value.get("src", value.get("source")), value.get("dst", value.get("target"))
        if isinstance(src, str) and isinstance(dst, str):
            yield src, dst
        elif "glossary" in value:
            yield from entries(value["glossary"])
        else:
            yield from ((k, v) for k, v in value.items() if isinstance(v, str))


def from_json(raw: bytes) -> list[tuple[str, str]]:
    return list(entries(json.loads(raw.decode("utf-8-sig"))))


def _balanced(text: str) -> Iterator[str]:
    """Outermost bracketed runs that close in order, strings skipped."""
    stack, start = [], 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', text):
        mark = m[0]
        if mark in "[{":
            start = start if stack else m.start()
            stack.append(mark)
        elif mark in "]}" and stack:
            if stack.pop() != {"]": "[", "}": "{"}[mark]:
                stack = []
            elif not stack:
                yield text[start : m.end()]


def repaired(text: str) -> str:
    """Escapes line breaks, tabs and stray backslashes inside strings, and drops commas before closing brackets."""
    inside = lambda m: re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", m[0]).replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return re.sub(r",(\s*[\]}])", r"\1", re.sub(r'"(?:[^"\\]|\\.)*"', inside, text, flags=re.S))


def recovered(answer: str) -> object:
    """The first JSON that parses: the whole answer, fenced parts, balanced runs, outermost brackets; then each repaired."""
    tries = [answer, *re.findall(r"```[\w-]*\s*(.*?)```", answer, re.S), *_balanced(answer)]
    for a, b in ("[]", "{}"):
        if 0 <= answer.find(a) < answer.rfind(b):
            tries.append(answer[answer.find(a) : answer.rfind(b) + 1])
    for text in [*tries, *map(repaired, tries)]:
        try:
            value = json.loads(text.strip())
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            return value
    raise ValueError("no JSON in the answer")


def answers(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """rows (key, response_text) as pairs: key, ord, src, dst; an answer without JSON gives one row with its error."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += [(k, n, s, d, None) for n, (s, d) in enumerate(entries(recovered(text or "")))]
                except ValueError as error:
                    out.append((k, -1, None, None, str(error)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[key, "ord", "src", "dst", "error"])

    return rows.select(F.col(key).cast("long"), "response_text").mapInArrow(run, f"{key} long, ord long, src string, dst string, error string")


def to_csv(src: Column, dst: Column) -> Column:
    """One CSV line; fields are quoted only if they need it."""
    field = lambda c: F.when(c.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", field(src), field(dst))


def to_json(src: Column, dst: Column) -> Column:
    return F.to_json(F.struct(src.alias("src"), dst.alias("dst")))
