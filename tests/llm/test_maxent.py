"""The hashed maximum-entropy model against a plain Python form, and what its probabilities sum to."""

import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parent)]
from test_llm import SCHEMA, awkward_texts  # noqa: E402

from quillmill.llm import maxent  # noqa: E402
from quillmill.runtime import Scratch  # noqa: E402

SMALL = maxent.Shape(classes=8, slots=8, frequent=2, bits=9)
M64 = (1 << 64) - 1


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def tokens(text):
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", lowered(text))] + [b""]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    first, second = (["".join(rng.choices(s, k=rng.randint(1, 6))) for _ in range(60)] for s in ("abcde", "uvwxy"))
    texts = awkward_texts() + [" ".join(rng.choices(first if i % 2 else second, k=rng.randint(0, 60))) for i in range(400)]
    rows = [(i if i != 5 else None, t, None, None, None, 1, 2, 3, 0.5, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-9:], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def trained(docs):
    scratch = Scratch(docs.sparkSession)
    held = scratch.write(maxent.blocks(docs, SMALL, 4000), "blocks")
    counts = scratch.write(maxent.corpus_counts(held), "counts")
    return maxent.train(held, counts, SMALL, scratch, task_tokens=4000), held


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def plain(model, counts, n, v, history):
    """Probability of each known word and of the unknown word of each slot after a history, one by one."""
    back = [mix(maxent.xxh3_64_intdigest(w)) for w in reversed(history[-2:])]
    back += [int(maxent.START)] * (2 - len(back))
    one, two = back
    features = [one * 3 & M64, mix((one + 5 * two) & M64), (two * 7 + 1) & M64]

    def rows(group):
        h = [f if group is None else (f + group * 0xD6E8FEB86659FD93) & M64 for f in features]
        return [(((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) & M64) >> (64 - SMALL.bits) for x in h]

    def softmax(weights, at, share):
        z = [float(share[k]) + sum(float(weights[r, k]) for r in at) for k in range(len(share))]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        return [x / sum(e) for x in e]

    p = [a * b for g, a in enumerate(softmax(model.class_rows, rows(None), model.class_share)) for b in softmax(model.slot_rows, rows(g), model.slot_share[g])]
    signed = lambda w: maxent.xxh3_64_intdigest(w) - (1 << 64 if maxent.xxh3_64_intdigest(w) >> 63 else 0)
    place = lambda w: model.frequent.get(signed(w), maxent.place(w, SMALL))
    return lambda w: p[place(w)] * (counts[w] + 1) / model.slot_total[place(w)], [p[k] / t for k, t in enumerate(model.slot_total.tolist()) if k >= SMALL.frequent * SMALL.slots]


def taught(rows):
    return [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]


def test_scores_against_plain_form(docs, trained):
    (model, n, v), held = trained
    rows = docs.collect()
    counts = Counter(w for r in taught(rows) for w in tokens(r.text))
    assert (n, v) == (sum(counts.values()), len(counts))
    assert np.abs(model.class_rows).max() > 0.1 and np.abs(model.slot_rows).max() > 0.1 and len(model.frequent) == SMALL.frequent * SMALL.slots
    got = {}
    for row in held.collect():
        body = maxent.pa.Table.from_pylist([row.asDict()], schema=maxent.pa.schema([("block", "int64"), ("doc_ids", maxent.pa.list_(maxent.pa.int64())), ("held", maxent.pa.list_(maxent.pa.bool_())), ("lengths", maxent.pa.list_(maxent.pa.int32())), ("ids", "binary"), ("words", maxent.pa.list_(maxent.pa.int64())), ("places", maxent.pa.list_(maxent.pa.int32()))]))
        by = {maxent.xxh3_64_intdigest(w): c for w, c in counts.items()}
        c = np.array([by.get(w % (1 << 64), 0) for w in row.words])
        for r in maxent.scored({k: body.column(k)[0] for k in body.column_names}, c, model, SMALL, n, v, batch=7).to_pylist():
            got[r["doc_id"]] = r
    for r in rows:
        words, want = tokens(r.text), 0.0
        if len(words) > 200:
            continue
        for k, w in enumerate(words):
            want += math.log10(plain(model, counts, n, v, words[:k])[0](w))
        found = got[r.doc_id]
        assert found["n_tokens"] == len(words) and found["n_known"] == sum(counts[w] > 0 for w in words) and found["train_tokens"] == n
        assert found["score"] == pytest.approx(want, abs=1e-3, rel=1e-4)
        assert found["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-9)


def test_probabilities_sum_to_one(docs, trained):
    (model, n, v), _ = trained
    counts = Counter(w for r in taught(docs.collect()) for w in tokens(r.text))
    for history in ([], [b"a"], tokens("abc abd aaa uu"), [b"never-seen", b"nor-this"]):
        known, unknown = plain(model, counts, n, v, history)
        assert sum(map(known, counts)) + sum(unknown) == pytest.approx(1, abs=1e-6)


def test_query(docs, spark):
    rows = maxent.score(docs, SMALL).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.n_tokens == len(tokens(texts[r.doc_id])) and math.isfinite(r.score) and r.score < 0
    assert maxent.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_order_of_words_is_learned(spark):
    """Texts that step through the same forty words: a token follows from the one before it, which counts can't tell."""
    rng = random.Random(8)
    known = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]
    texts = [" ".join(known[(a + k) % 40] for k in range(50)) for a in rng.choices(range(40), k=500)]
    rows = maxent.score(spark.createDataFrame([(i, t, *[None] * 9) for i, t in enumerate(texts)], SCHEMA), maxent.Shape(bits=12)).collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.7 * sum(r.n_tokens for r in out)


def test_only_held_out_documents(spark):
    some = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = maxent.score(spark.createDataFrame([(some, "a b", *[None] * 9)], SCHEMA)).first()
    assert row.held_out and (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0) and row.score < 0


def test_long_text_in_parts(trained, monkeypatch):
    """Features reach back over the parts that a long text is scored in."""
    words = np.arange(50, dtype=np.int64) * 7919
    ids = np.random.default_rng(1).integers(0, 50, 3000).astype(np.int32)
    begins = np.array([0, 10, 11, 2000])
    whole = maxent.histories(words, ids, begins)
    for lo in (1, 2, 9, 10, 11, 12, 13, 1999, 2001, 2003):
        before = max(lo - 2, 0)
        inside = begins[begins >= before] - before
        if before and (not len(inside) or inside[0]):
            inside = np.append(0, inside)
        assert (maxent.histories(words, ids[before:], inside)[:, lo - before :] == whole[:, lo:]).all()
