"""Splitting oversized blocks: parts concatenate to the text, none over the limit, no grapheme cut in two."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import TOKEN
from quillmill.operators.packer import HARD_LIMIT

#: From the coarsest: paragraphs, lines, sentences, words; each part keeps its separator.
SEPARATORS = [r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?。！？…])(?=\s|[^\x00-\x7f])", r"(?<=\s)(?=\S)"]


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return [regex.compile(s) for s in SEPARATORS], regex.compile(r"\X"), regex.compile(TOKEN)


SPACE, LETTER, NUMBER, OTHER, STOP = range(5)  #: kinds of characters; a stop, which may end a sentence, is another one, too


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every character, as the default counter tells them apart."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[[ord(c) for c in ".!?。！？…"]] = STOP
    return table


@lru_cache(maxsize=1)
def _narrow_kinds() -> bytes:
    return _kinds()[:256].tobytes()


class Places:
    """A text's characters with the default counter's tokens and the places of its separators, found once.

    Every separator ends with a character that is neither letter nor number, so no token lies on both sides of one, and
    the tokens of what stands between two are those that begin there.
    """

    def __init__(self, text: str):
        self.text = text
        if text.isascii():
            narrow = text.encode("ascii")
            self.codes, self.kinds = np.frombuffer(narrow, np.uint8), np.frombuffer(narrow.translate(_narrow_kinds()), np.uint8)
        else:
            self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.kinds = _kinds()[self.codes]
        begins = self.kinds >= OTHER
        letters = self.kinds == LETTER
        begins[:1] |= letters[:1]
        begins[1:] |= letters[1:] & ~letters[:-1]
        numbers = np.flatnonzero(self.kinds == NUMBER)
        if len(numbers):
            heads = np.flatnonzero(np.diff(numbers, prepend=-2) != 1)
            begins[numbers[(numbers - np.repeat(numbers[heads], np.diff(heads, append=len(numbers)))) % 3 == 0]] = True
        self.before = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])
        self.cuts: dict[int, np.ndarray] = {}

    def tokens(self, start: int, end: int) -> int:
        """Of the text between two places; what follows a cut inside a word is counted by itself."""
        if start and self.kinds[start - 1] in (LETTER, NUMBER):
            return count_tokens(self.text[start:end])
        return int(self.before[end] - self.before[start])

    def separated(self, level: int) -> np.ndarray:
        """The places inside the text where the separators of a level (see SEPARATORS) end."""
        if level not in self.cuts:
            last, next_ = self.codes[:-1], self.codes[1:]
            if level < 2:
                ends = last == 10
                if level == 0:
                    ends[1:] &= last[:-1] == 10
                    ends[:1] = False
            elif level == 2:
                ends = (self.kinds[:-1] == STOP) & ((self.kinds[1:] == SPACE) | (next_ > 0x7F))
            else:
                ends = (self.kinds[:-1] == SPACE) & (self.kinds[1:] != SPACE)
            self.cuts[level] = np.flatnonzero(ends) + 1
        return self.cuts[level]

    def inside(self, start: int, end: int, level: int) -> list[int]:
        found = self.separated(level)
        return found[np.searchsorted(found, start, "right") : np.searchsorted(found, end, "left")].tolist()

    def parts(self, start: int, end: int, limit: int, level: int = 0) -> list[int]:
        """The ends of the parts that `split` makes."""
        if self.tokens(start, end) <= limit:
            return [end]
        while level < len(SEPARATORS) and not (cuts := self.inside(start, end, level)):
            level += 1
        if level == len(SEPARATORS):
            return self.graphemes(start, end, limit)
        cuts.append(end)
        ends, at, held, tokens, seen = [], start, start, 0, int(self.before[start])
        for cut, total in zip(cuts, self.before[cuts].tolist(), strict=True):
            n, seen = total - seen, total
            if at > held and tokens + n > limit:
                ends.append(at)
                held, tokens = at, 0
            if n > limit:
                *whole, _ = self.parts(at, cut, limit, level + 1)
                if whole:
                    ends += whole
                    held = whole[-1]
                tokens = self.tokens(held, cut)
            else:
                tokens += n
            at = cut
        return [*ends, end]

    def graphemes(self, start: int, end: int, limit: int) -> list[int]:
        ends, at, held, tokens = [], start, start, 0
        for m in _patterns()[1].finditer(self.text[start:end]):
            # a character by itself is a token or a space
            n = int(self.kinds[start + m.start()] != SPACE) if m.end() - m.start() == 1 else count_tokens(m[0])
            if at > held and tokens + n > limit:
                ends.append(at)
                held, tokens = at, 0
            tokens += n
            at = start + m.end()
        return [*ends, end]


def count_tokens(text: str) -> int:
    """The default counter, as functions.text.token_count."""
    return len(_patterns()[2].findall(text)) if len(text) < 200 else int(Places(text).before[-1])


def split(text: str, limit: int, count: Callable[[str], int] = count_tokens, level: int = 0) -> list[str]:
    """Greedy parts of at most `limit` tokens at the coarsest separators that allow it, graphemes at last.

    With the default counter tokens and separators are found once a text; another one counts the parts of every level.
    """
    if count is count_tokens:
        ends = Places(text).parts(0, len(text), limit, level)
        return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    if count(text) <= limit:
        return [text]
    separators, grapheme, _ = _patterns()
    pieces = [p for p in separators[level].split(text) if p] if level < len(separators) else grapheme.findall(text)
    if len(pieces) == 1 and level < len(separators):
        return split(text, limit, count, level + 1)
    parts, held, tokens = [], "", 0
    for piece in pieces:
        n = count(piece)
        if held and tokens + n > limit:
            parts.append(held)
            held, tokens = "", 0
        if n > limit and level < len(separators):
            *whole, held = split(piece, limit, count, level + 1)
            parts += whole
            tokens = count(held)
        else:
            held, tokens = held + piece, tokens + n
    return [*parts, held] if held else parts


def chunked(blocks: list[tuple[str, bool]], limit: int, hard_limit: int = HARD_LIMIT, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks of a document's (text, breakable) blocks; see operators.packer for the rules."""
    done: list[str] = []
    held, tokens = [], 0

    def flush():
        nonlocal held, tokens
        if held:
            done.append("".join(held))
        held, tokens = [], 0

    for text, breakable in blocks:
        n = count(text)
        if breakable and n > limit:
            flush()
            parts = split(text, limit, count)
            done += parts[:-1]
            held, tokens = [parts[-1]], count(parts[-1])  # stays open for what follows
        elif not breakable and (n > hard_limit or n > limit):
            flush()
            done.append(text)
        else:
            if held and tokens + n > limit:
                flush()
            held.append(text)
            tokens += n
    flush()
    return done or [""]


def chunk_units(units: DataFrame, limit: int, key: str = "path") -> DataFrame:
    """Units (key, ordinal, text, breakable) as chunks: key, sequence, text. A document is packed as one ordered stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, []

        def made() -> pa.RecordBatch:
            texts = chunked(blocks, limit)
            return pa.record_batch([pa.array([at] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=[key, "sequence", "text"])

        for batch in batches:
            for name, text, breakable in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at and blocks:
                    yield made()
                    blocks = []
                at = name
                blocks.append((text or "", bool(breakable)))
        if blocks:
            yield made()

    ordered = units.repartition(key).sortWithinPartitions(key, "ordinal")
    return ordered.select(F.col(key).cast("string"), "text", "breakable").mapInArrow(run, f"{key} string, sequence long, text string")
