"""Vocabularies of public tokenizers, loaded once per Python process; their paths are parameters.

`byte_ids` and `word_ids` give exactly the ids of the `tokenizers` library. Text made only of characters whose
classes are the same everywhere goes through a rank-table encoder built from the same file; any other text goes
through the library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Character classes of the stable range below U+0250 and of general punctuation, as explicit sets.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r \\x85\\xa0"
UNSAFE = re.compile("[^\\x00-ɏ‐-‧‰-⁞]")
#: For lower-casing vocabularies: letters whose lower case stays in the range, one for one.
UNSAFE_CASE = re.compile("[^\\x00-įı-ſ‐-‧‰-⁞]")


def long_run(text: str) -> bool:
    """Whether a run without a space, or of white space alone, may be longer than 2000 characters.

    Such texts go to the library, whose merging is not quadratic in a run's length.
    """
    if len(text) < 2000:
        return False
    return any(" " not in (part := text[i : i + 1000]) or part.isspace() for i in range(0, len(text) - 999, 1000))


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def described(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """Bytes of each token of a byte-level vocabulary, added tokens included."""
    j, stand = described(path), byte_chars()
    table = {i: bytes(stand[c] for c in t) for t, i in j["model"]["vocab"].items() if all(c in stand for c in t)}
    return table | {a["id"]: a["content"].encode() for a in j["added_tokens"]}


@lru_cache(maxsize=4)
def byte_encoder(path: str):
    """A function text -> ids (uint32 array) for a byte-level BPE vocabulary whose ids rank its merges."""
    import tiktoken

    j, lib = described(path), library(path)
    added = {a["content"]: a["id"] for a in j["added_tokens"]}
    ranks = {b: i for i, b in token_bytes(path).items() if i not in added.values()}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    allowed = set(added)

    def encode(text: str) -> np.ndarray:
        if long_run(text) or not text.isascii() and UNSAFE.search(text):
            return np.array(lib.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    return encode


@lru_cache(maxsize=4)
def word_encoder(path: str):
    """A function text -> ids (uint32 array) for a lower-casing BPE vocabulary with word ends.

    Each word gets a line feed as its end mark (no word holds one), so that the end-of-word symbols become ordinary
    byte strings of the rank table: the marks merge first because their symbols have the lowest ranks of all pairs.
    """
    import tiktoken

    j, lib, stand = described(path), library(path), byte_chars()
    added = {a["content"] for a in j["added_tokens"]}
    special = re.compile("|".join(map(re.escape, sorted(added))))
    suffix = j["model"]["end_of_word_suffix"]
    ranks = {}
    for t, i in j["model"]["vocab"].items():
        if t in added:
            continue
        ends = t.endswith(suffix)
        b = bytes(stand[c] for c in (t[: -len(suffix)] if ends else t)) + b"\n" * ends
        if b != b"\n":  # the bare line feed never occurs: text has none left, a mark is always merged
            ranks[b] = i
    fast = tiktoken.Encoding("word_ends", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
    words = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")

    def encode(text: str) -> np.ndarray:
        if long_run(text) or "<|" in text and special.search(text) or not text.isascii() and UNSAFE_CASE.search(text):
            return np.array(lib.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        found = words.findall(text.lower())
        return fast.encode_to_numpy("\n".join(found) + "\n", disallowed_special=()) if found else np.empty(0, np.uint32)

    return encode


def vocabulary_size(path: str) -> int:
    j = described(path)
    return 1 + max([*j["model"]["vocab"].values(), *(a["id"] for a in j["added_tokens"])])
