"""BPE encoding and decoding: speculate and verify (operator 5).

Distinct words are encoded once: an automaton proposes the greedy longest-match tokens of all new words of a batch,
a vectorised check tests every adjacent pair of proposed tokens, and only words with a failing pair undergo exact
merging. A sequence of tokens is the BPE encoding of its bytes just if each adjacent pair is, so a word whose pairs
all pass needs no merging at all.

Null and empty texts give no ids; texts of any length are encoded whole; equal rows each give a row. An empty table
gives an empty result; further columns, whatever their names, have no effect.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import vocab
from quillmill.llm.batches import bounded, small

GAP = "Ā"  #: between words in the automaton's input, where each byte is one character below it


class SpeculativeBpe:
    """Encoder and decoder of one byte-level vocabulary file; `max_words` bounds the memory of known words."""

    def __init__(self, path: str, max_words: int = 300_000):
        import ahocorasick
        import regex

        j, stand = vocab.described(path), vocab.byte_chars()
        self.table = vocab.token_bytes(path)
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        ids = {b: i for i, b in self.table.items() if i not in set(self.added.values())}
        self.ids, self.max_words = ids, max_words
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        raw = lambda t: bytes(stand[c] for c in t)
        self.merges = {(ids[raw(a)], ids[raw(b)]): (rank, ids[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}
        size = max(ids.values()) + 1
        #: Of each token: the rank of the merge that makes it (-1: a byte), its left and right part.
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        for (a, b), (rank, made) in self.merges.items():
            self.rank[made], self.left[made], self.right[made] = rank, a, b
        code = np.array([a << 20 | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(code)
        self.pair_code, self.pair_rank = code[order], np.array([r for r, _ in self.merges.values()])[order]
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.known: dict[str, bytes] = {}
        letters, numbers, spaces = vocab.LETTERS, vocab.NUMBERS, vocab.SPACES
        self.safe_words = re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
        self.all_words = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def words(self, text: str) -> list[str]:
        return (self.all_words if vocab.UNSAFE.search(text) else self.safe_words).findall(text)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each pair of tokens apart.

        Walks both tokens' merge trees back in time from the joint: the edge whose merge comes last is undone first,
        and at each moment the two edge tokens then side by side must have no merge that would come before the one
        that consumes either of them (on equal ranks, the merge further left comes first).
        """
        a, b = first.copy(), second.copy()
        good = np.ones(len(a), bool)
        until_a, until_b = np.full(len(a), np.iinfo(np.int64).max), np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while live.size:
            x, y = a[live], b[live]
            code = x.astype(np.int64) << 20 | y
            at = np.searchsorted(self.pair_code, code).clip(max=len(self.pair_code) - 1)
            rank = np.where(self.pair_code[at] == code, self.pair_rank[at], np.iinfo(np.int64).max)
            # a's own consuming merge is further left, so it wins a tie; b's is further right, so it loses one
            joins = (rank < until_a[live]) & (rank <= until_b[live]) & (rank < np.iinfo(np.int64).max)
            good[live[joins]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_a = rx >= ry  # the merge that came last is undone first; of equal ones the right one
            undo_a &= ~((rx == ry) & (rx >= 0))
            done = joins | ((rx < 0) & (ry < 0))
            ia, ib = live[~done & undo_a], live[~done & ~undo_a]
            until_a[ia], a[ia] = self.rank[a[ia]], self.right[a[ia]]
            until_b[ib], b[ib] = self.rank[b[ib]], self.left[b[ib]]
            live = live[~done]
        return good

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE of a word: again and again the merge of lowest rank, the leftmost of equal ones."""
        if len(word) > 48:
            return self.merged_long(word)
        merge, never = self.merges.get, (1 << 30, 0)
        ids = [self.byte_id[b] for b in word]
        found = [merge(p, never) for p in zip(ids, ids[1:], strict=False)]
        while found:
            least = min(found)
            if least is never:
                break
            i = found.index(least)
            ids[i : i + 2] = [least[1]]
            del found[i]
            if i:
                found[i - 1] = merge((ids[i - 1], ids[i]), never)
            if i < len(found):
                found[i] = merge((ids[i], ids[i + 1]), never)
        return ids

    def merged_long(self, word: bytes) -> list[int]:
        """The same over a linked list and a queue, not quadratic in the word's length."""
        ids, n = [self.ids[word[i : i + 1]] for i in range(len(word))], len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, x, y, made = heapq.heappop(queue)
            k = after[i]
            if not alive[i] or k >= n or ids[i] != x or ids[k] != y:
                continue
            ids[i], alive[k], after[i] = made, False, after[k]
            if after[k] < n:
                before[after[k]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(queue, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def learn(self, words: list[str]) -> None:
        """Encode words not met yet: propose, check all pairs at once, merge what fails."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(b) + 1 for b in raw]) - 1  # where each word's GAP stands
        hits = list(self.automaton.iter_long(GAP.join(b.decode("latin-1") for b in raw)))
        tokens = np.fromiter((v[0] for _, v in hits), np.int64, len(hits))
        stops = np.fromiter((e for e, _ in hits), np.int64, len(hits))
        widths = np.fromiter((v[1] for _, v in hits), np.int64, len(hits))
        of = np.searchsorted(ends, stops, side="left")
        covered = np.bincount(of, weights=widths, minlength=len(raw)).astype(np.int64)
        failed = covered != np.array([len(b) for b in raw])  # the automaton must have covered every byte
        inside = np.flatnonzero(of[1:] == of[:-1])
        pairs, at = np.unique(tokens[inside] << 20 | tokens[inside + 1], return_inverse=True)
        fits = self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))
        failed[of[inside[~fits[at]]]] = True
        first = np.searchsorted(of, np.arange(len(raw) + 1), side="left")
        packed = tokens.astype("<u4").tobytes()
        for k, (word, b) in enumerate(zip(words, raw, strict=True)):
            self.known[word] = np.array(self.merged(b), dtype="<u4").tobytes() if failed[k] else packed[4 * first[k] : 4 * first[k + 1]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.specials.split(t) if self.added and self.specials.search(t) else [t] for t in texts]
        split = [[p if p in self.added else self.words(p) for p in text] for text in parts]
        every = [words for text in split for words in text if isinstance(words, list)]
        new = set().union(*every).difference(self.known)
        if len(self.known) + len(new) > self.max_words:
            self.known.clear()
            new = set().union(*every)
        if new:
            self.learn(sorted(new))
        find = self.known.__getitem__
        return [b"".join(b"".join(map(find, p)) if isinstance(p, list) else self.added[p].to_bytes(4, "little") for p in text) for text in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def coder(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def round_trip(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (and the ids, as bytes, if `keep_ids`)."""
    docs = bounded(docs)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer_path)
        for batch in small(batches, 1000):
            ids = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            cols = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.record_batch(cols + [pa.array(ids, pa.binary())] * keep_ids, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
