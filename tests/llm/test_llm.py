"""The training-data operators against plain Python forms, on small tables with every awkward case."""

import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent)]
import brute  # noqa: E402

from quillmill.llm import bpe, chat, cutting_stock, dedup, huffman, neighbours, packing, pii, quality, sharding, token_files, toxicity, vocab  # noqa: E402
from quillmill.runtime import Scratch  # noqa: E402

BYTES, WORDS = vocab.default_path("byte_bpe_50k.json"), vocab.default_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, part int, score double, value long, label string"


def vocabulary(rng, n=300):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(n)]


def awkward_texts():
    rng = random.Random(5)
    known = vocabulary(rng)
    prose = lambda n: " ".join(rng.choices(known, k=n))
    return [
        None, "", " ", "\n\t\x0b\x0c\r", "a", "one two three four", "ONE two Three four FIVE", "one two three four five",
        prose(60), prose(3000), "x" * 6000, " " * 4000, "<|endoftext|> and <|startoftext|>", "naïve façade Ünïcödé İstanbul ΣΑΣ ﬁne é   \x85\xa0\x1c",
        "漢字かな交じり文 한국어 русский עברית 😀👩‍👩‍👧", "don't WE'LL it's 'sl", "12345 6789 ½²³ ٣٤", "same words here again " * 40, prose(60), "line\nline\nline\n\nother\n line",
        "### *** $$$ %%% &&& || <<>> " * 20, "mail a.b@c.de, x@y.co.uk and .@a.b@c.d", "ip 1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.255.", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 1" + "2" * 40,
        "tel +1 (389) 555-5010, +49 30 1234567 +12 34", "IBAN GB82 WEST 1234 5698 7654 32 call 555-123-4567 ssn: 123-45-6789", "9" * 5000, "a@" * 2000, "1.1" * 2000, "+1" + "-" * 3000,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, 1, 2, 3, 0.5, 7, "x") for i, t in enumerate(awkward_texts())]
    rows += rows[8:12]  # equal rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ids_equal_the_library():
    texts = [t or "" for t in awkward_texts()]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c) * 2}1 {chr(c)}\n" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for path, name, encoder in ((BYTES, "byte_bpe_50k.json", vocab.byte_encoder), (WORDS, "word_bpe_49k.json", vocab.word_encoder)):
        encode = encoder(path)
        want, _ = brute.library_ids(name, texts)
        assert [encode(t).tolist() for t in texts] == want


def test_speculative_bpe_equals_the_library():
    rng, model = random.Random(1), bpe.coder(BYTES)
    texts = [t or "" for t in awkward_texts()] + ["".join(rng.choices("abcdeinrstT ", k=60)) for _ in range(2000)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c) * 2}1 {chr(c)}\n" for c in range(0x3000)]
    texts += [model.table[i].decode("latin-1") for i in range(0, 50256, 7)]
    want, lib = brute.library_ids("byte_bpe_50k.json", texts)
    got = model.encode_batch(texts)
    assert got == [brute.u32(x) for x in want]
    assert [model.decode(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_query(docs, empty):
    rows = bpe.round_trip(docs, BYTES).collect()
    texts = dict(enumerate(awkward_texts()))
    want, lib = brute.library_ids("byte_bpe_50k.json", list(texts.values()))
    assert len(rows) == docs.count()
    for r in rows:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(brute.u32(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, BYTES).count() == 0


def test_cutting_stock_uses_every_piece_once():
    rng = random.Random(2)
    for hot in (0, 4000):
        lengths = {}
        for n in [rng.randint(1, 255) for _ in range(3000)] + [140] * hot:
            lengths[n] = lengths.get(n, 0) + 1
        used, sequences = {}, 0
        for sizes, copies, times in cutting_stock.plan(lengths, 256):
            assert (sizes * copies).sum() <= 256
            sequences += times
            for s, k in zip(sizes.tolist(), copies.tolist(), strict=True):
                used[s] = used.get(s, 0) + k * times
        assert used == lengths
        sizes = np.array(sorted(lengths, reverse=True))
        bound = cutting_stock.relax(sizes, np.array([lengths[s] for s in sizes.tolist()]), 256, gap=0)[1].sum()
        assert sequences <= 1.01 * bound + 1


def test_packing(docs, empty):
    rows = packing.pack(docs, BYTES, seq_len=128).collect()
    want, _ = brute.library_ids("byte_bpe_50k.json", awkward_texts())
    pieces, sequences = {}, {}
    for r in rows:
        ids = [*want[r.doc_id], 0]
        assert r.doc_tokens == len(ids) and brute.crc(ids[r.start : r.start + r.length]) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = {i: 2 if 8 <= i < 12 else 1 for i in range(len(want))}
    for i, ids in enumerate(want):
        assert sorted(pieces[i]) == sorted([(s, min(128, len(ids) + 1 - s)) for s in range(0, len(ids) + 1, 128)] * copies[i])
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(empty, BYTES).count() == 0


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "é one"), (1, 2, "user", "more"), (1, 3, "assistant", "two"), (2, 0, "user", None), (3, 0, "assistant", "only"), (4, 0, None, "x"), (4, 0, None, "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.format_pairs(chat.own_pairs(frame)).collect()}
    assert rows[1].prompt == "<|user|>\nhi\n<|assistant|>\né one\n<|user|>\nmore\n" and rows[1].prompt_turns == 3
    assert (rows[1].chosen, rows[1].rejected) == ("<|assistant|>\ntwo\n", "<|assistant|>\né one\n")
    assert (rows[1].chosen_mask, rows[1].rejected_mask) == ("14:17", "14:19")
    assert (rows[2].prompt_turns, rows[2].chosen, rows[2].chosen_mask) == (1, "", "")
    assert (rows[3].prompt, rows[3].chosen, rows[3].rejected) == ("", "<|assistant|>\nonly\n", "<|assistant|>\n\n")
    assert rows[4].prompt_turns == 2
    assert chat.format_pairs(chat.own_pairs(frame.filter("false"))).count() == 0


def family_docs():
    """Copies, stars, drifting chains, shared passages and short texts."""
    rng = random.Random(11)
    known = vocabulary(rng, 3000)
    prose = lambda n: rng.choices(known, k=n)
    texts = [t for t in awkward_texts()]

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(known)
        return out

    for size in (9, 30, 55, 70, 90, 200, 600):
        base = prose(size)
        texts += [" ".join(edited(base, max(1, size // d))) for d in (200, 60, 40, 30, 25, 20) for _ in range(4)] + [" ".join(base), " ".join(base).upper(), "  ".join(base)]
        step = prose(size)
        for _ in range(12):
            step = edited(step, max(1, size // 60))
            texts.append(" ".join(step))
    passage = prose(80)
    texts += [" ".join(prose(n) + passage + prose(n)) for n in (1, 3, 5, 8, 10, 12, 15, 40, 200) for _ in range(4)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates(spark, empty):
    docs = family_docs()
    want = brute.near_components(docs)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, label int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.link(frame).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}
    assert {r.doc_id for r in dedup.accept(frame).collect()} == {d for d, (_, c) in want.items() if d == c}
    assert dedup.link(empty).count() == 0


def test_hub_chosen_twice_hides_no_link(spark):
    """B ~ C; A holds all that they share, is linked with neither and is their lists' hub in both rounds."""
    trios = []
    for seed in range(2000):
        word = lambda n, seed=seed: [f"t{seed}w{i}" for i in n]
        texts = [" ".join(word(range(42)) + word(range(b, b + n))) for b, n in ((100, 28), (200, 2), (300, 2))]
        a, b, c = (dedup.shingle_hashes(t) for t in texts)
        keys = [dedup.set_key(h) for h in (a, b, c)]
        if min(keys) == keys[0] and np.isin(np.intersect1d(b, c), a[:64]).all():
            trios += [(seed, i, bytearray(k), t) for i, (k, t) in enumerate(zip(keys, texts, strict=True))]
    hubs = spark.createDataFrame(trios, "seed int, i int, cid binary, text string").groupBy("seed").agg(F.min_by("i", F.xxhash64(F.lit(1), "cid")).alias("hub"))
    chosen = hubs.filter("hub = 0").agg(F.min("seed")).first()[0]
    trio = [t for seed, _, _, t in trios if seed == chosen]
    docs = list(enumerate(trio))
    got = {r.doc_id: r.component_id for r in dedup.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute.near_components(docs).items()} == {0: 0, 1: 1, 2: 1}


def test_near_duplicates_with_null_and_equal_doc_ids(spark):
    word = lambda a, b: [f"n{i}" for i in range(a, b)]
    first, bridge, last = (" ".join(word(a, a + 200)) for a in (0, 20, 40))
    frame = spark.createDataFrame([(1, first), (None, bridge), (None, bridge), (2, last)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in dedup.link(frame).collect()) == [(0, 1), (0, 1), (1, 1), (2, 1)]
    clean, other = " ".join(word(1000, 1100)), " ".join(word(2000, 2100))
    rows = [(1, first), (7, first + " x"), (7, clean), (8, other), (8, other + " x"), (9, ""), (9, ""), (10, clean + " y")]
    stay = dedup.accept(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in stay) == [1, 7, 8, 9] and [r.text for r in stay if r.doc_id == 7] == [clean]


def test_near_duplicates_in_blocks(spark):
    """Small blocks and no hub round: every pair goes through the block comparison."""
    docs = family_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: c for d, (_, c) in brute.near_components(docs).items()}
    whole, check = dedup.block_links, dedup.verified
    try:
        dedup.block_links = lambda *a, **k: whole(*a, **k, rows=8)
        dedup.verified = lambda pairs, *a, **k: pairs.limit(0)
        assert {r.doc_id: r.component_id for r in dedup.link(frame).collect()} == want
        dedup.verified = lambda *a, **k: check(*a, **k, salted=2, spread=3)
        assert {r.doc_id: r.component_id for r in dedup.link(frame).collect()} == want
    finally:
        dedup.block_links, dedup.verified = whole, check


def test_near_duplicates_of_structured_words(spark):
    """Words of two letters whose polynomial hashes modulo a power of two agree are told apart; further columns clash with nothing."""
    word, other = "a", "b"
    while len(word) < 2048:
        word, other = word + other, other + word
    docs = [(1, word), (2, other), (3, " ".join(["x", "y", "z", "u", word, "v", "x", "y", "z", "u", other, "v"]))]
    frame = spark.createDataFrame([(*d, b"c", 3, "t", 7) for d in docs], "doc_id long, text string, cid binary, hub int, value string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.link(frame).collect()}
    assert got == brute.near_components(docs) and got[1][1] == 1 and got[2][1] == 2


def test_sharding(docs, empty):
    rows, texts = sharding.shard(docs, 4).collect(), awkward_texts()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(4))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard(empty).count() == 0


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", "big" if i % 3 else f"one{i}" if i % 2 else "mid") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).groupBy("shard", "source").count().collect()
    for source, n in (("big", 2000), ("mid", 500)):
        counts = [r["count"] for r in got if r.source == source]
        assert len(counts) == 10 and all(abs(c - n / 10) <= 2 for c in counts)


def test_shards_by_plain_order(spark):
    """Ranks within sources, the order of all rows and the cuts, against plain Python."""
    rng = random.Random(14)
    rows = [(i, rng.choice(["t", "tt", None]), rng.choice(["a"] * 20 + ["b", "c", None])) for i in range(3000)] + [(7, "same", "d")] * 150
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string"), 7).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.source, []).append(r.fraction)
    for source, fractions in by.items():
        n = sum(s == source for _, _, s in rows)
        ranks = [f * n for f in sorted(fractions)]
        own = ranks[0]
        assert len(ranks) == n and 0 <= own < 1 and all(abs(x - i - own) < 1e-6 for i, x in enumerate(ranks))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    total = len(order)
    assert [(r.shard, r.slot) for r in order] == [(k * 7 // total, k - -(-(k * 7 // total) * total // 7)) for k in range(total)]
    assert all(a.fraction <= b.fraction for a, b in zip(order, order[1:], strict=False))


def test_long_conversation(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"turn {k} é😀") for k in range(3000)] + [(None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*t, "c", "r") for t in turns], "conv_id long, turn long, role string, text string, chosen string, prefix string")
    got = {r.conv_id: r for r in chat.format_pairs(chat.own_pairs(frame)).collect()}
    assert got[1].prompt_turns == 2999 and got[1].chosen_mask == f"14:{14 + len('turn 2999 é😀')}"
    everything = frame.sparkSession.range(1).select(chat.spans_text(chat.assistant_spans(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for _, k, r, t in turns[:60]])))).first()[0]
    at, want = 0, []
    for _, _, role, text in turns[:60]:
        start = at + len(role) + 5
        want += [f"{start}:{start + len(text)}"] if role == "assistant" else []
        at = start + len(text) + 1
    assert everything == ",".join(want) and (got[None].prompt_turns, got[None].chosen) == (2, "")


def test_lists_searched_hold_enough_neighbours():
    """A query at its centroid, whose list is small: the distance ratio alone stops there."""
    x = np.random.default_rng(8).normal(size=(600, 8))
    index = neighbours.Centroids(x, 40, 20, 4, 1.1, 0.97)
    held = np.full(len(index.points), 5)
    index.keep = 4
    for p in index.points:
        at, d = index.walk(p, index.keep)
        assert held[at[d <= index.ratio * d[0] + 1e-12]].sum() < 21
        lists = index.lists_of(p, held, 21)
        assert len(set(lists.tolist())) == len(lists) and held[lists].sum() >= 21 * index.replicas
    assert len(index.lists_of(index.points[0], np.ones(len(held), np.int64), 21)) == len(held)


def test_neighbours(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(400 + i, [1.0] * 8) for i in range(60)]
    odd = [(900, None), (920, []), (940, [0.0] * 8), (960, [float("nan")] * 8), (980, [None] * 8), (981, [float("inf")] * 8)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors + odd], "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(frame, frame.filter("vec_id % 20 = 0"), bucket_rows=50, query_rows=7).collect()
    exact = {r[0]: r[1] for r in frame.select("vec_id", "embedding").collect() if r[0] < 900}
    hits = total = 0
    for q in [i for i in exact if i % 20 == 0]:


        def score(i, q=q):  # from first to last; sum() would compensate
            total = 0.0
            for x, y in zip(exact[q], exact[i], strict=True):
                total += x * y
            return total

        best = sorted((i for i in exact if i != q), key=lambda i: (-score(i), i))[:20]
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(r.score == score(r.vec_id) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({r.vec_id for r in rows} & set(best))
        total += 20
    assert hits >= 0.9 * total and len(got) == total
    assert neighbours.search(frame.filter("false"), frame.filter("false")).count() == 0


def test_neighbours_of_many_components_and_lengths(spark):
    """Recall at a realistic length, short lists of another length, groups of equal vectors, and scores that tie."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 48))
    x = np.concatenate([centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 48)) * 0.7, rng.normal(size=(1500, 48))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[20].tolist()) for i in range(40)] + [(6000 + i, [float(i % 3), 1.0]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got: dict = {}
    for r in neighbours.search(frame, frame.filter("vec_id % 20 = 0"), bucket_rows=700).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    exact = np.concatenate([x, np.repeat(x[20:21], 40, 0)]).astype(float)
    names = np.array([*range(len(x)), *range(5000, 5040)])
    hits = total = 0
    for q in (i for i, _ in rows if i % 20 == 0 and i < 6000):
        score = exact @ exact[np.flatnonzero(names == q)[0]]
        best = [n for _, n in sorted(zip(-score, names.tolist(), strict=True)) if n != q][:20]
        hits += len(set(best) & {n for _, n in got[q]})
        total += 20
        assert [k for k, _ in sorted(got[q])] == list(range(1, 21))
    assert hits >= 0.9 * total
    short = {i: v for i, v in rows if i >= 6000}
    for q in (i for i in short if i % 20 == 0):
        best = sorted((i for i in short if i != q), key=lambda i: (-sum(a * b for a, b in zip(short[q], short[i], strict=True)), i))[:20]
        assert [n for _, n in sorted(got[q])] == best


def test_few_vectors_go_through_lists_too(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 24)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    made, fit = [], neighbours.sample_index
    monkeypatch.setattr(neighbours, "sample_index", lambda *args, **more: made.append(fit(*args, **more)) or made[-1])
    got: dict = {}
    for r in neighbours.search(frame, frame.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(made) == 1 and len(made[0][0].points) > 40
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    assert sum(len(got[q] & set(np.argsort(-exact[q])[:20].tolist())) for q in got) >= 0.9 * 20 * len(got) and len(got) == 30


def test_pii(docs, empty):
    texts = awkward_texts()
    for r in pii.digest(docs).collect():
        want = brute.pii(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[:5], r
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.KINDS[:4]] == [s for s in want[5].split(",") if s]
        if r.doc_id == 25:
            assert {s.split(":")[0] for s in r.spans.split(",")} == {"iban", "local_phone", "ssn"}
    assert pii.digest(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[21] == "mail [EMAIL], [EMAIL] and [EMAIL]@c.d" and masked[0] is None and masked[8] == texts[8]
    assert pii.mask(docs).columns == docs.columns


def test_many_private_spans(spark, empty):
    """Thousands of spans in one text, and spans that overlap, against the plain form; columns of any name stay."""
    rng = random.Random(12)
    many = " ".join(rng.choice(["a{0}.b@c{0}.org", "10.0.{0}.7", "x", "+49 30 {0}1234567", "4111 1111 1111 1111", "555-123-4567"]).format(rng.randint(1, 250)) for _ in range(6000))
    texts = [many, "mail 10.0.0.1@4111.1111.1111.1111.org +4111 1111 1111 1111 end", "1.2.3.4@x.org", None, ""]
    docs = spark.createDataFrame([(i, t, "p", "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, _pii string, _row string, n_chars long")
    spans = {}
    for r in pii.digest(docs).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii(texts[r.doc_id])[:5]
        spans[r.doc_id] = r.spans
    hidden = pii.mask(docs)
    assert hidden.columns == docs.columns
    for r in hidden.collect():
        assert r.text == (None if texts[r.doc_id] is None else brute.masked(texts[r.doc_id], spans[r.doc_id])) and (r._pii, r._row) == ("p", "r")
        assert r.n_chars == (len(r.text) if spans[r.doc_id] else 1)
    assert pii.mask(empty).count() == 0 and pii.digest(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    known = vocabulary(rng, 500)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices(known, k=60) + (["zzuffle" + rng.choice(known)] * 2 + ["grobnik"] if bad else []))))
        if i % 3:
            labels.append((i, 1, int(bad)))
    labels += [(1, 1, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.predict(frame, marks).collect()
    assert len(got) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in got) >= 590
    few = toxicity.predict(docs, marks).collect()
    assert len(few) == docs.count() and all(0 <= r.score <= 1 for r in few)
    assert {r.score for r in toxicity.predict(docs, marks.filter("false")).collect()} == {0.0}
    assert toxicity.predict(empty, marks).count() == 0
    assert {r.doc_id for r in toxicity.accept(frame, marks).collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_no_toxic_gram_is_folded(spark):
    rng = random.Random(6)
    known = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)})
    texts = [(i, " ".join(known[i :: 100]), int(i % 4 == 0)) for i in range(100)] + [(1000, "never labelled aaaaaaaaaa", None)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts if t[2] is not None], "doc_id long, toxic int")
    want = {0: brute.Counter(), 1: brute.Counter()}
    for i, text, toxic in texts:
        if toxic is not None and zlib.crc32(str(i).encode()) % 5:
            for w in text.split():
                padded = "\x02" * 5 + w + "\x03"
                want[toxic].update(padded[k : k + 6] for k in range(len(padded) - 5))
    words = toxicity.counted(docs, labels).cache()
    grams = toxicity.gather(words).withColumns({"t": F.col("t") + F.col("ft"), "o": F.col("o") + F.col("fo")}).cache()
    got = {bytes(r.gram).decode("utf-32-le"): (r.o, r.t) for r in grams.filter("o + t > 0").collect()}
    assert len(got) > 10_000 and got == {g: (want[0][g], want[1][g]) for g in want[0] | want[1]}
    ratios = toxicity.log_ratios(grams, {"ratio": (F.col("t"), F.col("o"))}, Scratch(spark)).cache()
    asked = ["never", "aaaaaaaaaa", *rng.sample(known, 4), "", None, " ".join(rng.choices(known, k=50) + ["aaaaaaaaaa"] * 3), "q" * 3000]
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    few, many = (sorted(map(tuple, toxicity.featured(frame, ratios, ["doc_id"], broadcast_rows=n).collect())) for n in (10**6, 0))
    assert few == many and len(few) == len(asked)
    for (_, x0, x1, x2, x3), text in zip(few, asked, strict=True):
        found = [brute.kneser_ney_ratio(w, want[1], want[0]) for w in (text or "").split()]
        assert abs(x0 - sum(found) / max(1, sum(len(w) + 1 for w in (text or "").split()))) < 1e-9
        far = sum(math.copysign(max(abs(brute.kneser_ney_ratio(w, want[1], want[0])) - toxicity.BEYOND, 0), brute.kneser_ney_ratio(w, want[1], want[0])) for w in set((text or "").split()))
        n = max(1, len(set((text or "").split())))
        assert abs(x1 - far / n) < 1e-9 and abs(x2 - far / n**0.5) < 1e-9 and abs(x3 - math.log1p(max(far, 0))) < 1e-9


def test_token_files(spark, docs, empty, tmp_path):
    token_files.write_token_files(docs, f"file://{tmp_path}/f", WORDS, block_tokens=500)
    rows = sorted(token_files.read_token_files(spark, f"file://{tmp_path}/f").collect(), key=lambda r: (r.doc_id, r.start))
    want, _ = brute.library_ids("word_bpe_49k.json", awkward_texts())
    at = 0
    for r in rows:
        ids = [*want[r.doc_id], 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert len(rows) == docs.count()
    token_files.write_token_files(empty, f"file://{tmp_path}/e", WORDS)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_code_lengths_are_best_when_unlimited():
    import heapq

    counts = np.array([0, 5, 9, 12, 13, 16, 45, 1, 1, 0])
    heap = [(int(n), i) for i, n in enumerate(counts) if n]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 99))
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost
    steep = huffman.code_lengths(2 ** np.arange(40, dtype=np.int64))
    assert steep.max() <= huffman.LIMIT and (2.0 ** -steep.astype(float)).sum() <= 1


def test_quality(docs, empty):
    texts = awkward_texts()
    for r in quality.judge(docs).collect():
        want = brute.quality(texts[r.doc_id])
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    assert quality.accept(docs).columns == docs.columns


def test_clashing_columns(spark):
    names = ["doc_id", "text", "source", "n_chars", "kept", "x1", "q_n_words", "host_rate", "toxic_score", "label", "cid", "at", "n"]
    rows = [(i, " ".join(f"w{i}x{k % 70}" for k in range(80)), "s", 1, False, 2.5, 3, 0.5, 9.0, "l", "c", 4, 5) for i in range(20)]
    frame = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    for stage in (quality.accept, lambda d: toxicity.accept(d, labels, threshold=2.0), dedup.accept, pii.mask):
        assert sorted(map(tuple, stage(frame).collect())) == sorted(rows)


def test_host_verdict_comes_back_to_documents(spark):
    clean, junk = " ".join(f"wo{i}rd" for i in range(80)), " ".join(f"w#{i}*" for i in range(80))
    rows = [(i, junk if i % 10 else clean, "bad") for i in range(200)] + [(1000 + i, clean, "good") for i in range(200)] + [(5000, junk, "good"), (5001, junk, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] == (i % 10 == 0) for i in range(200)) and all(kept[1000 + i] for i in range(200)) and kept[5000]


def test_stages_on_awkward_and_empty_tables(spark, docs, empty):
    """Nulls, empty and long texts, repeated rows and further columns pass every stage; an empty table gives none."""
    sys.path[:0] = [str(Path(__file__).parents[2])]
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars", "label", "hub", "score"]
    given = docs.withColumn("hub", F.lit("h")).unionByName(docs.withColumn("hub", F.lit("h"))).select(*columns)
    for frame in (given, empty.withColumn("hub", F.lit("h")).select(*columns)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, frame, sf)
            rows = made.collect()
            if name == "packing":
                assert (len(rows) > 0) == (frame is given) and {r.doc_id for r in rows} == {r.doc_id for r in frame.select("doc_id").collect()}
            else:
                assert made.columns == columns and len(rows) <= frame.count() and (frame is given or not rows)
                assert name != "near_dedup" or len(rows) == len({(r.doc_id, r.text) for r in rows})


def test_pipeline(spark):
    """Every stage against its plain form, on what its predecessor kept; the models' verdict is taken as given."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r for r in frame.collect()}
    clean = stages["quality"](spark, frame, sf).cache()
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == brute.kept_by_quality([(r.doc_id, r.text, r.source) for r in whole.values()])
    mild = stages["toxicity"](spark, clean, sf).cache()
    scores = toxicity.predict(clean, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {r.doc_id for r in mild.collect()}
    assert left == {r.doc_id for r in scores.collect() if not r.predicted} and 0 < len(left) < clean.count()
    single = stages["near_dedup"](spark, mild, sf).cache()
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in brute.near_components([(d, whole[d].text) for d in left]).items() if d == c}
    spans = {r.doc_id: r.spans for r in pii.digest(single).collect()}
    private = {r.doc_id: r for r in stages["pii"](spark, single, sf).collect()}
    for d, r in private.items():
        assert r.text == brute.masked(whole[d].text, spans[d]) and (r.lang, r.source) == (whole[d].lang, whole[d].source)
    want, _ = brute.library_ids("byte_bpe_50k.json", [r.text for r in private.values()])
    ids = {d: [*x, 0] for d, x in zip(private, want, strict=True)}
    got: dict = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        assert brute.crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in got.items()} == {d: len(x) for d, x in ids.items()}
