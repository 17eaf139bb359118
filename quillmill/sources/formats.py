"""Document formats as ordered text units.

Each parser takes a file's bytes and gives units: (ordinal, kind, address, text, breakable). An address says where a
unit's text goes back to: a JSON pointer, a character range, a text node's number, a part of an archive and its node.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Unit = tuple[str, str, str, bool]  # kind, address, text, breakable
UNITS = "path string, format string, ordinal long, kind string, address string, text string, breakable boolean, error string"

# Extension -> format.
FORMATS = {"pdf": "pdf", "md": "markdown", "epub": "epub", "html": "html", "htm": "html", "txt": "txt", "docx": "docx", "xlsx": "xlsx", "json": "json", "srt": "srt", "ass": "ass", "lrc": "lrc"}
# Content format of each format.
CONTENT = {"pdf": "markdown", "markdown": "markdown", "epub": "xhtml", "html": "html", "json": "json", "txt": "plain-text", "docx": "xml", "xlsx": "xml", "srt": "srt", "ass": "ass", "lrc": "lrc"}
HIDDEN = {"script", "style", "link", "meta", "template"}
ATTRIBUTES = ("alt", "title", "placeholder")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def format_of(path: str) -> str | None:
    return FORMATS.get(path.rpartition("/")[2].rpartition(".")[2].lower()) if "." in path else None


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8-sig")


def txt(raw: bytes) -> list[Unit]:
    return [("text", "", decoded(raw), True)]


_STRUCTURE = re.compile(r"^\s*(?:>|#|\||[-*+] |[0-9]+\. )", re.M)
_FENCE = re.compile(r"\s*(?:```|~~~)")


def markdown(raw: bytes) -> list[Unit]:
    """Blocks end after blank lines, fenced code stays whole; blocks with structure or inline marks aren't breakable."""
    blocks, held, fenced = [], [], False
    for line in decoded(raw).splitlines(keepends=True):
        held.append(line)
        if _FENCE.match(line):
            fenced = not fenced
            ends = not fenced
        else:
            ends = not fenced and not line.strip()
        if ends:
            blocks.append("".join(held))
            held = []
    if held or not blocks:
        blocks.append("".join(held))
    plain = lambda b: not (_FENCE.match(b) or _STRUCTURE.search(b) or re.search(r"[`*_]|\]\(|!\[|~~", b))
    return [("block", str(i), b, plain(b)) for i, b in enumerate(blocks)]


def json_strings(raw: bytes) -> list[Unit]:
    """Every string value in document order, addressed by its JSON pointer."""
    found: list[Unit] = []
    stack = [("", json.loads(decoded(raw)))]
    while stack:
        at, value = stack.pop()
        if isinstance(value, str):
            found.append(("value", at, value, False))
        elif isinstance(value, list):
            stack += [(f"{at}/{i}", v) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, dict):
            stack += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(value.items())]
    return found


class _Page(HTMLParser):
    """Visible text nodes in order, then translatable attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[tuple[int, str]] = []
        self.attributes: list[tuple[int, str, str]] = []
        self.texts = self.elements = 0
        self.pending = ""

    def _flush(self):
        if self.pending:
            shown = not any(t in HIDDEN for t in self.open) and ("head" not in self.open or "title" in self.open)
            if shown and self.pending.strip():
                self.nodes.append((self.texts, self.pending.strip()))
            self.texts += 1
            self.pending = ""

    def handle_data(self, data):
        self.pending += data

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag not in HIDDEN and not any(t in HIDDEN for t in self.open):
            self.attributes += [(self.elements, k, v.strip()) for k, v in attrs if k in ATTRIBUTES and v and v.strip()]
        self.elements += 1
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def close(self):
        super().close()
        self._flush()


def html(raw: bytes, prefix: str = "") -> list[Unit]:
    page = _Page()
    page.feed(decoded(raw))
    page.close()
    return [("text", f"{prefix}node:{i}", t, True) for i, t in page.nodes] + [("attribute", f"{prefix}element:{i};{k}", v, False) for i, k, v in page.attributes]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub(raw: bytes) -> list[Unit]:
    """Pages in spine order, then the other HTML items of the manifest."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(book.read(root))
        items = {e.get("id"): e for e in package.iter() if _local(e.tag) == "item"}
        pages = [k for k, e in items.items() if "html" in (e.get("media-type") or "")]
        spine = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref"]
        order = list(dict.fromkeys([*(k for k in spine if k in items), *pages]))
        found: list[Unit] = []
        for k in order:
            name = posixpath.normpath(posixpath.join(posixpath.dirname(root), items[k].get("href")))
            if name in book.namelist():
                found += html(book.read(name), f"{name};")
        return found


def _ooxml(raw: bytes, part: str, block: str, text: str, solid: str) -> list[Unit]:
    """Text nodes of each outermost block of a part; a block with several nodes, or inside `solid`, isn't breakable."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        if part not in archive.namelist():
            return []
        source = archive.read(part)
    found: list[Unit] = []
    state = {"block": -1, "depth": 0, "solid": 0, "node": 0, "inside": False}
    nodes: list[tuple[int, str]] = []
    held: list[str] = []
    name = lambda tag: tag.rpartition(":")[2]

    def start(tag, _):
        if name(tag) == solid:
            state["solid"] += 1
        elif name(tag) == block:
            if not state["depth"]:
                state["block"] += 1
                nodes.clear()
            state["depth"] += 1
        elif name(tag) == text and state["depth"]:
            state["inside"] = True
            held.clear()

    def end(tag):
        if name(tag) == solid:
            state["solid"] -= 1
        elif name(tag) == text and state["inside"]:
            nodes.append((state["node"], "".join(held)))
            state["node"] += 1
            state["inside"] = False
        elif name(tag) == block:
            state["depth"] -= 1
            if not state["depth"]:
                whole = "".join(t for _, t in nodes)
                if whole.strip():
                    address = f"block:{state['block']};nodes:{','.join(f'{i}+{len(t)}' for i, t in nodes)}"
                    found.append(("block", address, whole, len(nodes) == 1 and not state["solid"]))

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: held.append(data) if state["inside"] else None
    parser.Parse(source, True)
    return found


def docx(raw: bytes) -> list[Unit]:
    return _ooxml(raw, "word/document.xml", "p", "t", "tbl")


def xlsx(raw: bytes) -> list[Unit]:
    return _ooxml(raw, "xl/sharedStrings.xml", "si", "t", "")


_CUE = re.compile(r"[^\S\n]*\S[^\n]*\n(?P<time>[^\n]*-->[^\n]*)(?:\n|\Z)(?P<body>(?:[^\S\n]*\S[^\n]*(?:\n|\Z))*)")


def srt(raw: bytes) -> list[Unit]:
    """Cue bodies by character range; blank bodies have none but keep their number."""
    text, at, number, found = decoded(raw), 0, 0, []
    while True:
        while (m := re.compile(r"[^\S\n]*(?:\n|\Z)").match(text, at)) and m.end() > at:
            at = m.end()
        if at >= len(text):
            return found
        if not (m := _CUE.match(text, at)):
            raise ValueError(f"no cue at character {at}")
        body = m["body"].rstrip("\r\n")
        if body.strip():
            found.append(("cue", f"entry:{number};range:{m.start('body')}:{m.start('body') + len(body)}", body, True))
        number, at = number + 1, m.end()


def ass(raw: bytes) -> list[Unit]:
    """Texts of Dialogue lines, by character range; the Format line of [Events] says how many fields precede them."""
    found, at, fields, number, events = [], 0, 10, 0, False
    for line in decoded(raw).splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        if bare.startswith("["):
            events = bare.strip().lower() == "[events]"
        elif events and bare.lower().startswith("format:"):
            fields = bare.count(",") + 1
        elif events and bare.startswith("Dialogue:"):
            parts = bare.split(",", fields - 1)
            if len(parts) == fields and parts[-1].strip():
                start = at + len(bare) - len(parts[-1])
                found.append(("cue", f"entry:{number};range:{start}:{at + len(bare)}", parts[-1], True))
            number += 1
        at += len(line)
    return found


_LRC_TAG = re.compile(r"\[([^\]\n]*)\]")
_LRC_TIME = re.compile(r"\d+:\d{1,2}(?:[.:]\d{1,3})?")


def lrc(raw: bytes) -> list[Unit]:
    """Lyrics after time tags, and lines without tags; lines of id tags alone are skipped."""
    found, at = [], 0
    for number, line in enumerate(decoded(raw).splitlines(keepends=True)):
        bare = line.rstrip("\r\n")
        cursor, kinds = len(bare) - len(bare.lstrip()), set()
        while m := _LRC_TAG.match(bare, cursor):
            if _LRC_TIME.fullmatch(m[1]):
                kinds.add("time")
            elif ":" in m[1]:
                kinds.add("id")
            else:
                break
            cursor = m.end()
        start = 0 if not kinds else cursor + len(bare[cursor:]) - len(bare[cursor:].lstrip())
        if "time" in kinds or not kinds:
            if bare[start:].strip():
                found.append(("line", f"line:{number};range:{at + start}:{at + len(bare)}", bare[start:], True))
        at += len(line)
    return found


PARSERS: dict[str, Callable[[bytes], list[Unit]]] = {"txt": txt, "markdown": markdown, "json": json_strings, "html": html, "epub": epub, "docx": docx, "xlsx": xlsx, "srt": srt, "ass": ass, "lrc": lrc}


def parsed(files: DataFrame) -> DataFrame:
    """files (path, content binary) as units; a file that can't be parsed gives one row with its error.

    PDF pages need a converter that gives Markdown; without one they are reported like unknown formats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in UNITS.split(", ")]
        for batch in batches:
            out = []
            for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = format_of(path or "")
                try:
                    if kind not in PARSERS:
                        raise ValueError("unsupported format")
                    units = PARSERS[kind](raw or b"") or [("empty", "", "", True)]
                    out += [(path, kind, i, *u, None) for i, u in enumerate(units)]
                except Exception as error:  # noqa: BLE001  any fault of a file is that file's result
                    out.append((path, kind, 0, "error", "", "", False, f"{type(error).__name__}: {error}"[:500]))
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return files.select("path", "content").mapInArrow(run, UNITS)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """All files under a folder as units."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") > 0))
