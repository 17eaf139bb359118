"""Source divergence and the Merkle manifest against plain Python forms."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path[:0] = [str(Path(__file__).parent)]
from test_llm import SCHEMA, awkward_texts  # noqa: E402

from quillmill.llm import divergence, merkle  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    known = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 20))) for _ in range(120)] + ["éé" * 5, "漢字漢字漢字", "Zz", "zz"]
    texts = awkward_texts() + [" ".join(rng.choices(known, k=rng.randint(0, 90))) for _ in range(300)]
    rows = [(i if i % 41 else None, t, (None, "", "en", "de", "fr")[i % 5], f"s{i % 3}" if i % 7 else None, None if i % 4 else i, 1, 2, 3, 0.5, 7, "x") for i, t in enumerate(texts)]
    rows += rows[-40:] + [(9000, "", "xx", "only", 0, 1, 2, 3, 0.5, 7, "x"), (9001, None, "xx", None, 0, 1, 2, 3, 0.5, 7, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def audited(rows, least=10, first=10):
    terms = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    df, count, every = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source, found = r.lang or "", r.source or "", terms(r.text)
        every.add((lang, source))
        df[lang].update(set(found))
        count[lang, source].update(found)
        count[lang, None].update(found)
    kept = {lang: sorted(t for t, n in df[lang].items() if n >= least) for lang, _ in every}
    share = {}
    for (lang, source), n in count.items():
        total = sum(n[t] for t in kept[lang])
        share[lang, source] = {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}
    gap = lambda p, q: (p - q) * (p - q) // (p + q)
    out = []
    for lang, source in every:
        p = share[lang, source]
        pairs = [(-sum(gap(p[t], share[lang, s][t]) for t in p), s.encode(), s) for x, s in every if x == lang and s != source]
        q = share[lang, None]
        own = [(-gap(p[t], q[t]), t.encode(), t) for t in p if count[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", s, -v, k) for k, (v, _, s) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(own)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "shard"), [(10, 50_000), (2, 7)])
def test_divergence_against_plain_form(docs, least, shard):
    got = [tuple(r) for r in divergence.audit(docs, least, shard_terms=shard).collect()]
    want = audited(docs.collect(), least)
    assert sorted(got) == want
    assert {"pair", "term"} == {r[2] for r in want} and any(r[0] == "xx" and r[4] == 0 for r in want)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "word", "en", "s", None, 1, 2, 3, 0.5, 7, "x")], SCHEMA)
    assert divergence.audit(one).collect() == []


def test_runs_of_pointers():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("ab"), size=rng.integers(1, 40))) for _ in range(500)] * 3 + ["a" * 8, "a" * 16, "a" * 9, "a" * 8]
    low = np.frombuffer(("".join(f"{w} " for w in words) + "\0" * 8).encode(), np.uint8)
    low = divergence.LETTER[low]
    starts, lengths = divergence.word_starts(low[:-8], np.array([0]))
    assert len(starts) == len(words)
    order, new = divergence.sorted_runs(low, starts, lengths)
    assert [words[i] for i in order] == sorted(words)
    assert new.sum() == len(set(words))
    keys = rng.integers(0, 50, 200_000).astype(np.uint64)
    assert (divergence.parted(keys, 1000) == np.argsort(keys, kind="stable")).all()


def test_slices_of_any_size(docs):
    whole = divergence.counted(docs).groupBy("lang", "source", "term").sum("n", "df")
    cut = divergence.counted(docs, slice_bytes=64, batch_rows=3).groupBy("lang", "source", "term").sum("n", "df")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_exact_shares():
    counts, total = np.array([0, 1, 7 * 10**14, 10**15 - 1]), np.array(10**15)
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * int(c) // 10**15 for c in counts]
    empty = pa.record_batch([pa.array([], pa.string())] * 3, names=["text", "lang", "source"])
    assert divergence.counted_slice(empty).num_rows == 0


def manifested(rows):
    enc = lambda v: b"-" if v is None else (lambda b: b"%d:" % len(b) + b)(str(v).encode())
    leaf = lambda r, text: sha256(b"".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, text)))).hexdigest()

    def up(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for path, a in zip(paths, at, strict=True):
                run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
                path.append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
            nodes, at = [merkle.digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [a // 8 for a in at]
        return nodes[0], paths

    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r) for r in rows if r.lang == lang), key=lambda x: x[:3])
        trees.append((own, *up([x[2] for x in own])))
    root, upper = up([t[1] for t in trees])
    out = []
    for (own, subroot, lower), above in zip(trees, upper, strict=True):
        for (_, _, node, r), path in zip(own, lower, strict=True):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            folded = leaf(r, "".join(c.lower() if c.isascii() else c for c in r.text)) if hit else node
            for left, right in path + above:
                folded = merkle.digest(left + folded + right)
            out.append((r.doc_id, node, subroot, root, merkle.digest("".join(a + b for a, b in path + above)), folded, folded == root))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("height", [1, 4])
def test_manifest_against_plain_form(docs, height):
    got = [tuple(r) for r in merkle.manifest(docs, height).collect()]
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == manifested(docs.collect())
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_little(spark, docs):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = docs.filter("doc_id = 9000")
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == merkle.digest("") and row.verified
    large = spark.createDataFrame([(2**53 + k, None, None, None, None, 1, 2, 3, 0.5, 7, "x") for k in (1, 3)] + [(None,) * 11], SCHEMA)
    assert [r.doc_id for r in merkle.manifest(large).orderBy("doc_id").collect()] == [None, 2**53 + 1, 2**53 + 3]
