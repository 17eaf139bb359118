"""Writing translated units back into their formats."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.sax.saxutils import escape as xml_escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.sources.formats import format_of

Pieces = list[tuple[str, str]]  # address, new text


def joined(sequence: str, text: str) -> Column:
    """The default rendering: a group's texts in sequence."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(sequence, text))), lambda x: x[text]), "")


def patched(text: str, pieces: Pieces) -> str:
    """Replace character ranges from right to left; overlapping ranges are an error."""
    spans = sorted(((int(a), int(b), new) for at, new in pieces for a, b in [re.search(r"range:(\d+):(\d+)", at).groups()]), reverse=True)
    limit = len(text)
    for start, end, new in spans:
        if end > limit or start > end:
            raise ValueError(f"overlapping range {start}:{end}")
        text, limit = text[:start] + new + text[end:], start
    return text


def json_document(raw: bytes, pieces: Pieces) -> str:
    """Set the values at JSON pointers; key order stays."""
    tree = [json.loads(raw.decode("utf-8-sig"))]
    for pointer, new in pieces:
        keys = [k.replace("~1", "/").replace("~0", "~") for k in pointer.split("/")[1:]]
        at, last = tree, 0
        for k in keys:
            at = at[last]
            last = int(k) if isinstance(at, list) else k
        at[last] = new
    return json.dumps(tree[0], ensure_ascii=False, indent=2)


_PART = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S)


def html_document(raw: bytes, pieces: Pieces) -> str:
    """Replace the cores of text nodes and attribute values; all other markup stays as it was."""
    text, new = raw.decode("utf-8-sig"), dict(pieces)
    out, at, nodes, elements, raw_until = [], 0, 0, 0, None

    def node(s: str) -> str:
        nonlocal nodes
        if not s:
            return s
        got = new.get(f"node:{nodes}")
        nodes += 1
        if got is None:
            return s
        core = s.strip()
        return s[: s.index(core)] + escape(got, quote=False) + s[s.index(core) + len(core) :] if core else s

    for m in _PART.finditer(text):
        if raw_until and not re.match(rf"</{raw_until}\b", m[0], re.I):
            continue
        raw_until = None
        out.append(node(text[at : m.start()]))
        tag = m[0]
        if name := re.match(r"<([A-Za-z][^\s/>]*)", tag):
            for key in ("alt", "title", "placeholder"):
                if (value := new.get(f"element:{elements};{key}")) is not None:
                    tag = re.sub(rf"(\b{key}\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]+)", lambda x, v=value: f'{x[1]}"{escape(v)}"', tag, count=1, flags=re.I)
            elements += 1
            raw_until = name[1] if name[1].lower() in ("script", "style") else None
        out.append(tag)
        at = m.end()
    return "".join(out) + node(text[at:])


def ooxml(raw: bytes, part: str, text: str, pieces: Pieces) -> bytes:
    """Replace text nodes of one archive part; a block's whole text goes to its first node, the others become empty."""
    new: dict[int, str] = {}
    for address, value in pieces:
        nodes = [int(x.split("+")[0]) for x in re.search(r"nodes:([\d,+]+)", address)[1].split(",")]
        new |= {n: "" for n in nodes[1:]} | {nodes[0]: value}
    count = -1

    def swap(m: re.Match) -> str:
        nonlocal count
        count += 1
        return m[0] if count not in new else f"{m[1]}{xml_escape(new[count])}{m[3]}"

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in source.infolist():
            data = source.read(item.filename)
            if item.filename == part:
                data = re.sub(rf"(<(?:\w+:)?{text}(?:\s[^>]*)?(?<!/)>)([^<]*)(</(?:\w+:)?{text}>)", swap, data.decode()).encode()
            target.writestr(item, data)
    return out.getvalue()


def epub_book(raw: bytes, pieces: Pieces) -> bytes:
    """Rebuild an archive with its pages rendered."""
    pages: dict[str, Pieces] = {}
    for address, value in pieces:
        name, _, rest = address.partition(";")
        pages.setdefault(name, []).append((rest, value))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in source.infolist():
            data = source.read(item.filename)
            target.writestr(item, html_document(data, pages[item.filename]).encode() if item.filename in pages else data)
    return out.getvalue()


def rendered(kind: str, raw: bytes, pieces: Pieces) -> bytes:
    """A file with the texts at the units' addresses replaced."""
    if kind in ("srt", "ass", "lrc"):
        return patched(raw.decode("utf-8-sig"), pieces).encode()
    if kind == "json":
        return json_document(raw, pieces).encode()
    if kind == "html":
        return html_document(raw, pieces).encode()
    if kind == "epub":
        return epub_book(raw, pieces)
    if kind == "docx":
        return ooxml(raw, "word/document.xml", "t", pieces)
    if kind == "xlsx":
        return ooxml(raw, "xl/sharedStrings.xml", "t", pieces)
    return "".join(new for _, new in pieces).encode()


def documents(files: DataFrame, units: DataFrame) -> DataFrame:
    """path, content, error of files (path, content) with their units' texts (path, ordinal, address, text) put back.

    A unit without text keeps its source. A file that can't be rendered gives its error and no content.
    """
    own = units.filter(F.col("text").isNotNull()).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "address", "text"))).alias("pieces"))
    pieces = F.coalesce(F.transform("pieces", lambda x: F.struct(x["address"].alias("address"), x["text"].alias("text"))), F.array().cast("array<struct<address:string,text:string>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, raw, given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append((path, rendered(format_of(path or "") or "", raw or b"", [(x["address"], x["text"]) for x in given]), None))
                except Exception as error:  # noqa: BLE001  any fault of a file is that file's result
                    out.append((path, None, f"{type(error).__name__}: {error}"[:500]))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string()))], names=["path", "content", "error"])

    joined = files.select("path", "content").join(own, "path", "left").select("path", "content", pieces.alias("pieces"))
    return joined.mapInArrow(run, "path string, content binary, error string")
