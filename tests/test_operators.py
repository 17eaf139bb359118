"""Packer, placeholders, glossary, tasks, model and telemetry operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import catalog_edits, glossary, model, packer, placeholders, runs, splitting, tasks
from quillmill.sources import glossary_files
from quillmill.streaming import telemetry


def values(spark, column, *rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


@pytest.mark.parametrize("blocks,limit,want", [
    ([], 10, [(0, 0)]),
    ([(4, True), (6, True), (1, True)], 10, [(10, 2), (1, 1)]),
    ([(4, True), (11, False), (1, True)], 10, [(4, 1), (11, 1), (1, 1)]),
    ([(3, True), (10, False), (1, True)], 10, [(3, 1), (10, 1), (1, 1)]),
    ([(5, True), (2000, False), (5, True)], 8000, [(2010, 3)]),
    ([(5, True), (2001, False), (5, True)], 8000, [(5, 1), (2001, 1), (5, 1)]),
])
def test_packer(spark, blocks, limit, want):
    frame = spark.createDataFrame([(1, [("x", n, b) for n, b in blocks])], "doc_id long, blocks array<struct<text string, tokens int, breakable boolean>>")
    assert [(r.tokens, r.n_blocks) for r in packer.chunks(frame, limit).orderBy("sequence").collect()] == want


def test_packer_of_many_chunks(spark):
    """More chunks than go into one piece of the fold, with and without blocks that stand alone: no block is lost."""
    rng = random.Random(9)
    given = [(f"{i} ", rng.choice([1, 3, 9, 14]), rng.random() < 0.8) for i in range(3000)]
    frame = spark.createDataFrame([(1, given), (2, []), (3, None)], "doc_id long, blocks array<struct<text string, tokens int, breakable boolean>>")
    want, tokens, at = [], 0, 0
    for i, (_, n, breakable) in enumerate(given):
        alone = not breakable and n > 10
        if i > at and (alone or tokens + n > 10):
            want.append((at, i))
            at, tokens = i, 0
        if alone:
            want.append((i, i + 1))
            at, tokens = i + 1, 0
        else:
            tokens += n
    want += [(at, len(given))] if at < len(given) else []
    rows = packer.chunks(frame, 10, hard_limit=12).filter("doc_id = 1").orderBy("sequence").collect()
    assert len(rows) > 1000 and [(r.first_block, r.first_block + r.n_blocks) for r in rows] == want
    assert [r.text for r in rows] == ["".join(t for t, _, _ in given[a:b]) for a, b in want]


def test_last_split_part_stays_open():
    long = "one two three four five six seven. eight nine ten eleven twelve thirteen. "
    parts = splitting.chunked([(long, True), ("last", True)], 8)
    assert "".join(parts) == long + "last" and parts[-1].endswith("last") and all(splitting.count_tokens(p) <= 8 for p in parts[:-1])
    assert splitting.chunked([("!" * 50, False)], 5) == ["!" * 50] and splitting.chunked([], 5) == [""]
    family = "👩‍👩‍👧" * 30
    assert "".join(splitting.split(family, 7)) == family and all(len(p) % 5 == 0 for p in splitting.split(family, 7))


def test_splitting_at_places_found_once():
    """Parts and tokens as a counter gives them that counts every part of every level, and no separator is sought twice."""
    rng, by_parts = random.Random(5), lambda t: len(splitting._patterns()[2].findall(t))
    letters = ["a", "Word", "é", "漢字", "1234567", "٣٤", "½", " ", "  ", "\n", "\n\n", "\n\n\n", ". ", ".", "。", "!?", "…x", "\u00a0", "\u3000", "\x1c", "👩‍👩‍👧", "e\u0301", "\r\n", "_", "\x00"]
    for i in range(4000):
        text = "".join(rng.choices(letters, k=rng.choice((0, 3, 30, 200)))) if i % 9 else "".join(rng.choices(["a", "b", "1", "e\u0301", "漢"], k=80))
        limit = rng.choice((1, 2, 5, 9, 40))
        assert splitting.split(text, limit) == splitting.split(text, limit, by_parts), (text, limit)
        assert splitting.count_tokens(text) == by_parts(text)
    # every character alone and after a letter: kinds as the patterns have them
    for k in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}" for c in range(k, k + 4096) if not 0xD800 <= c < 0xE000)
        assert splitting.count_tokens(text) == by_parts(text)
    start = time.process_time()
    text = "One two, three four five six seven. Eight nine ten!\n" * 20_000
    assert "".join(splitting.split(text, 120)) == text
    assert time.process_time() - start < 0.5  # about 0.1; two seconds where every level counts again


def test_oversized_lines_are_split_before_packing(spark):
    """Every registered chunk against the plain packer, on the driver's texts."""
    import hashlib

    from quillmill.plans import catalogue

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = [x + "\n" for x in (r.text or "").split("\n")]
        lines[-1] = lines[-1][:-1]
        want[r.doc_id] = splitting.chunked([(x, True) for x in lines if x], catalogue.LIMIT)
        assert "".join(want[r.doc_id]) == (r.text or "")
    rows = catalogue.queries()["pack_chunks_rows"](spark, sf).collect()
    assert {(r.doc_id, r.sequence): r.text_md5 for r in rows} == {(d, k): hashlib.md5(c.encode()).hexdigest() for d, cs in want.items() for k, c in enumerate(cs)}
    assert max(r.tokens for r in rows) <= catalogue.LIMIT
    counts = catalogue.queries()["pack_lines_chunk_count"](spark, sf).collect()
    assert {r.doc_id: r.chunks for r in counts} == {d: len(c) for d, c in want.items()} and max(r.largest for r in counts) <= catalogue.LIMIT
    assert sum(r.chunks for r in catalogue.queries()["language_chunks"](spark, sf).collect()) == len(rows)


def test_native_and_python_token_counts_agree(spark):
    texts = ["", "a b", "don't 12345", "漢字 кир ½", "x_y\n\tz"]
    assert values(spark, T.token_count(F.col("x")), *texts) == [splitting.count_tokens(t) for t in texts]


def test_language(spark):
    texts = ["short", "eight letters", "漢字漢字漢字漢字", "かなかなかな漢字", "한국어한국어한국", "русский язык", "العربية لغة", "tôi là người nước Đức", "1234567890", "漢字abcdefghij"]
    assert values(spark, T.detect_language(F.col("x")), *texts) == [None, "en", "zh-CN", "ja", "ko", "ru", "ar", "vi", None, "en"]
    assert values(spark, T.normalise_language(F.col("x")), "EN", " Zh-Hant ", "auto", "xx", "Chinese (Traditional)", "zh-TW", "Simplified Chinese", "__other__") == ["en", "zh-HK", "auto", None, "zh-HK", "zh-HK", "zh-CN", None]
    assert values(spark, T.language_name(F.col("x")), "zh-CN", "ko", "auto") == ["Chinese (Simplified)", "Korean", None]
    assert values(spark, T.valid_target_language(F.col("x")), "zh-Hans", "Old Norse", "x", "en-", "old norse", "A" * 65) == [True, True, False, False, False, False]


def test_scalars(spark):
    assert values(spark, T.duration_ms(F.col("x")), "250ms", '"1.5S"', "2 m", "1h", "3", "0.0001ms", "x", "") == [250, 1500, 120000, 3600000, 3000, 1, None, None]
    assert values(spark, T.sanitised_stem(F.col("x")), ' a<b>:"c. ', "...", "") == ["abc", "untitled", "untitled"]
    assert values(spark, T.normalised_tags(F.split("x", ",")), " a ,A,b,,c") == [["a", "b", "c"]]
    many = F.concat(F.transform(F.sequence(F.lit(1), F.lit(13)), lambda n: F.concat(F.col("x"), n)))
    assert values(spark, T.tag_error(F.split("x", ",")), " a ,A", "x" * 49, "a\u0085b", "") == [None, "Task tags must be 48 characters or shorter", "Task tags cannot contain control characters", None]
    assert values(spark, T.tag_error(many), "t") == ["A task can have at most 12 tags"]
    with pytest.raises(Exception, match="at most 12 tags"):
        values(spark, T.normalised_tags(many), "t")
    texts = [" <think>x</think> y", "<thinking>never closed", "a <think>b</think>", "<think>a</think><think>b</think>c"]
    assert values(spark, T.without_thinking(F.col("x")), *texts) == ["y", "", "a <think>b</think>", "<think>b</think>c"]
    assert values(spark, T.leading_thinking(F.col("x")), *texts) == ["x", "never closed", "", "a"]
    assert values(spark, T.retry_delay_ms(F.col("x")), 0, 1, 5, 40, schema="x int") == [1500, 2250, 11391, 12000]
    assert values(spark, T.http_class(F.col("x")), 200, 404, 408, 429, 499, 503, schema="x int") == ["ok", "permanent", "transient", "rate-limited", "transient", "transient"]
    gone = T.model_unavailable(F.split_part("x", F.lit("|"), F.lit(1)).cast("int"), F.split_part("x", F.lit("|"), F.lit(2)))
    assert values(spark, gone, "404|The Model does not exist", "404|page not found", "500|model not found", "400|Deployment retired") == [True, False, False, True]
    assert values(spark, T.truncated_finish(F.col("x")), "MAX_TOKENS", "stop", "incomplete") == [True, False, True]
    assert values(spark, T.url_host(F.col("x")), "https://User@Ex.org:8080/a?b", "no url") == ["ex.org", ""]
    assert [str(v) for v in values(spark, T.timestamp_of(F.col("x")), "1700000000", "1700000000000")] == ["2023-11-14 22:13:20"] * 2


def test_markdown_protection():
    text = "> quoted **bold *inner* text**\n\nSee [docs](http://x.y/a_(b)) and ![pic](p.png) `co*de` ~~gone~~ 2*3*4\n```py\n**not**\n```\nend _em_"
    source, entries = placeholders.protect_markdown(text)
    assert [e["kind"] for e in entries] == ["quote", "code-block", "strong", "link", "image", "code", "strike", "emphasis"]
    assert "**" not in source and placeholders.restored(source, entries) == text
    moved = source.replace("docs", "Doku")
    assert "[Doku](http://x.y/a_(b))" in placeholders.restored(moved, entries)
    for plain in ("", "nothing here", "a ** b", "`open", "```\nunclosed"):
        made, kept = placeholders.protect_markdown(plain)
        assert placeholders.restored(made, kept) == plain


def test_tags():
    source, entries = placeholders.protect_markdown("a **b** and *c* `d`")
    assert source == "a <t1>b</t1> and <t2>c</t2> <t3>d</t3>"
    assert placeholders.normalised("< T 1 >x</ t一 > <t十二> <t二十> <t十十> <t两>") == "<t1>x</t1> <t12> <t20> <t十十> <t2>"
    restore = lambda t: placeholders.restored(t, entries)
    assert restore("<t2>C</t2> <T 1>B</T1> <t3>d</t3>") == "*C* **B** `d`"
    assert restore("<t1>b<t2>c</t1></t2> <t3>d</t3>") == "bc d"
    assert restore("<t1>b</t1> <t3>d</t3>") == "b d" and restore("<t1>b</t1><t2>c</t2><t3>d</t3><t4>e</t4>") == "bcde"
    assert placeholders.protect_html("x <b>y <i>z</i></b> <em> </em><br> <!-- <b>w</b>")[0] == "x <t1>y <i>z</i></t1> <em> </em><br> <!-- <b>w</b>"
    ass, kept = placeholders.protect_ass(r"{\i1}Hi\Nthere")
    assert ass == "<t1></t1>Hi<t2></t2>there" and placeholders.restored(ass, kept) == r"{\i1}Hi\Nthere"
    assert placeholders.unit_texts("<it0>a</it0>\n<it1>b</it1>", 2) == ["a", "b"] and placeholders.unit_texts("<it0>a</it0><it0>b</it0>", 2) is None
    assert placeholders.tagged_units([["a"], ["b", "c"]]) == ("<it0>a</it0>\n<it1><t2>b</t2><t3>c</t3></it1>", "a\nbc")


def test_glossary_matching(spark):
    terms = [(0, "New York"), (1, "york"), (2, "new"), (3, "東京"), (4, "C++"), (5, "NEW YORK")]
    texts = [(1, "new york, York_x york 東京都 C++11 xnew new"), (2, None), (3, "NewYork")]
    got = sorted(tuple(r) for r in glossary.matches(spark.createDataFrame(texts, "doc_id long, text string"), terms).collect())
    assert got == [(1, 0, 0, 8), (1, 1, 17, 21), (1, 2, 37, 40), (1, 3, 22, 24), (1, 4, 26, 29)]
    entries = [(0, " Cat ", "Katze"), (1, "CAT", "x"), (2, "", "y"), (3, "a\nb", "z"), (4, "dog", "Hund")]
    assert {r.src for r in glossary.normalised(spark.createDataFrame(entries, "entry_index long, src string, dst string")).collect()} == {"Cat", "dog"}
    pairs = [(2, 0, "Cat", "b", "a Cat"), (1, 0, "cat", "a", "cat"), (1, 1, "CAT", "c", "no"), (3, 0, "dog", "d", "Dog")]
    frame = spark.createDataFrame(pairs, "chunk_id long, ord long, src string, dst string, source_text string")
    kept = glossary.grounded(frame)
    assert sorted((r.chunk_id, r.ord) for r in kept.collect()) == [(1, 0), (2, 0)]
    assert [(r.norm, r.dst, r.conflicts) for r in glossary.merged(kept).collect()] == [("cat", "a", 1)]
    loose = [(1, 0, " cat ", "x\ty", "the cat."), (1, 1, "Cat", "z", "the cat."), (1, 2, "a\x07", "b", "a\x07")]
    frame = spark.createDataFrame(loose, "chunk_id long, ord long, src string, dst string, source_text string")
    assert [(r.src, r.dst) for r in glossary.grounded(frame).collect()] == [("cat", "x\ty")]
    assert [tuple(r) for r in glossary.discarded(frame).collect()] == [(1, 3, 2)]
    every = glossary.matches(spark.createDataFrame([(1, "new york", 0)], "doc_id long, text string, n int"), terms, overlaps=True).collect()
    assert sorted((r.entry_index, r.start) for r in every) == [(0, 0), (1, 4), (2, 0), (5, 0)]


def test_terms_that_stand_apart(spark):
    terms = [(0, "De í"), (1, "Éa"), (2, "(x)"), (3, "tan")]
    texts = [(1, "de íueue, éa"), (2, "DE Í ÉA"), (3, "a(X) (x)b (X)"), (4, "(x)"), (5, "a(x)b étanç tan_ İtan")]
    found = lambda **how: sorted((r.doc_id, r.entry_index, r.start) for r in glossary.matches(spark.createDataFrame(texts, "doc_id long, text string"), terms, overlaps=True, **how).collect())
    assert found(apart=True) == [(1, 1, 10), (2, 0, 0), (2, 1, 5), (3, 2, 10), (4, 2, 0), (5, 3, 7)]
    assert (1, 0, 0) in found() and (3, 2, 1) in found() and (1, 1, 10) not in found()


def test_every_term_is_tested_on_every_document(spark):
    from quillmill.plans import catalogue

    sf = "/root/testdata/sf0.001"
    entries = sorted((r.item_id, r.text.split(" ")[0]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").collect()}
    pairs = [(d, i, s) for d in sorted(texts) for i, s in entries if s and s in texts[d]]
    first, by = {}, {}
    for d, i, s in pairs:
        first.setdefault((d, s.strip().lower()), (i, s, f"{s}{i}"))
        by.setdefault(s.strip().lower(), []).append((s, f"{s}{i}"))
    got = catalogue.queries()["groundedness_filter"](spark, sf).collect()
    assert sorted((r.chunk_id, r.ord, r.src, r.dst) for r in got) == sorted((d, *x) for (d, _), x in first.items())
    assert any(r.chunk_id % 8 != r.ord % 8 for r in got)
    merged = catalogue.queries()["merge_first_wins"](spark, sf).collect()
    assert {r.norm: (r.src, r.dst, r.conflicts) for r in merged} == {n: (*x[0], len({dst for _, dst in x}) - 1) for n, x in by.items()}


def test_no_control_characters_in_grounded_sources(spark, tmp_path):
    from quillmill.plans import catalogue

    spark.createDataFrame([(0, "one.\nTwo x"), (1, "two\n x"), (2, "three\tx"), (3, "four x"), (4, " five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "one.\nTwo two\n three\tx four five"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.queries()["groundedness_filter"](spark, str(tmp_path)).collect()] == [(1, 3, "four", "four3")]


def test_glossary_recovery(spark):
    answers = ['Here: ```json\n[{"src":"a","dst":"b"}]\n``` done', '{"glossary":[{"source":"a","target":"b"},[{"x":"y"}]]}', 'say {"a": "li\nne",} ok', '[{"src":"a","dst":"b"}', "nothing"]
    got = [list(glossary_files.entries(glossary_files.recovered(a))) if a != "nothing" else None for a in answers]
    assert got == [[("a", "b")], [("a", "b"), ("x", "y")], [("a", "li\nne")], [("a", "b")], None]
    rows = glossary_files.answers(spark.createDataFrame(list(enumerate(answers)), "chunk_id long, response_text string")).collect()
    assert sum(r.error is not None for r in rows) == 1 and len(rows) == 6
    assert glossary_files.from_csv('﻿dst,src\r\n"x, ""y""",a\r\n\r\n'.encode()) == [("a", 'x, "y"')]
    with pytest.raises(ValueError):
        glossary_files.from_csv(b"src,dst,more\n")
    assert values(spark, glossary_files.to_csv(F.col("x"), F.lit('a"b')), "p,q") == ['"p,q","a""b"']


def test_tasks(spark):
    rows = [(1, "success", 10, -5), (1, "failed", 1, 1), (1, "pending", 0, 0), (2, "interrupted", 0, 0)]
    stats = {r.task_id: r for r in tasks.chunk_statistics(spark.createDataFrame(rows, "task_id long, status string, source_tokens long, target_tokens long")).collect()}
    assert (stats[1].total, stats[1].progress, stats[1].error_rate, stats[1].target_tokens) == (3, 2 / 3, 1 / 3, 1) and stats[2].error_rate == 1
    over = lambda f, t, p: spark.range(1).select(tasks.over_threshold(F.lit(f), F.lit(t), F.lit(p))).first()[0]
    assert (over(20, 100, 20), over(21, 100, 20), over(0, 1, 0)) == (False, True, False)
    with pytest.raises(Exception, match="invalid threshold"):
        over(0, 0, 20)
    allowed = lambda a, s: spark.range(1).select(tasks.allowed(F.lit(a), F.lit(s))).first()[0]
    assert allowed("resume", "interrupted") and allowed("retranslate", "failed") and not any(allowed(*x) for x in (("resume", "failed"), ("retranslate", "interrupted"), ("delete", "running"), ("x", "y")))
    again = tasks.resumed(spark.createDataFrame([("failed", "x", 3, "e"), ("success", "y", 4, None)], "status string, translated_text string, total_tokens long, error_message string")).collect()
    assert [tuple(r) for r in again] == [("pending", "", 0, None), ("success", "y", 4, None)]


def test_model(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    got = model.merged_roles(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("message").collect()
    assert [(r.role, r.text) for r in got] == [("user", "a\n\nb"), ("assistant", "c"), ("user", "d")]
    body = 'data: {"a":1}\n\n: note\nevent: x\ndata:[DONE]\ndata: {"b":2}\r\n'
    assert values(spark, model.framed(F.col("x")), body) == [['{"a":1}', '{"b":2}']]
    rows = [(1, 0.0), (1, float("nan")), (1, -0.5), (2, None)]
    got = {r.k: r.confidence for r in model.confidence(spark.createDataFrame(rows, "k long, lp double"), "k", "lp").collect()}
    import math

    p = [1.0, math.exp(-0.5)]
    mean = sum(p) / 2
    assert abs(got[1] - (mean - 0.5 * math.sqrt(sum((x - mean) ** 2 for x in p) / 2))) < 1e-12 and got[2] is None


def test_errors_and_usage(spark):
    messages = ["Glossary failure threshold exceeded: 2/9 chunks failed (maximum 20%): HTTP 500", "x HTTP 404 y", "HTTP 418 quota", "restore failed", "error rate", "bad AST", "Task paused", "boom"]
    got = values(spark, model.task_error(F.col("x")), *messages)
    assert [r.kind for r in got] == ["threshold", "http", "rate-limit", "placeholder", "error-rate", "parse", "interrupted", "other"]
    assert got[0].text == "失败分块 2/9，超过最大允许失败率 20%" and got[7].text == "任务异常：boom"
    used = F.when(F.col("x") >= 0, F.struct(F.col("x").alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(1).alias("cached_tokens")))
    stats = values(spark, model.token_stats(used, F.lit(7), F.lit(8), F.lit(3)), 0, -1, schema="x int")
    assert [tuple(r) for r in stats] == [(0, 2, 1, 3, 5), (7, 8, 0, 3, 18)]


def test_runs(spark):
    rows = [(1, k, "failed" if k in (2, 3, 5) else "success", f"e{k}") for k in range(10)] + [(2, k, "success", None) for k in range(3)] + [(3, 0, "failed", "x")]
    frame = spark.createDataFrame(rows, "task_id long, sequence long, status string, error_message string")
    assert sorted(tuple(r)[:4] for r in runs.aborted(frame, 20).collect()) == [(1, 10, 3, 5), (2, 3, 0, None), (3, 1, 1, 0)]
    assert sorted(tuple(r)[:4] for r in runs.aborted(frame, 30).filter("task_id = 1").collect()) == [(1, 10, 3, None)]
    assert values(spark, runs.poll_delay_ms(F.col("x")), 0, 2, 3, 60, schema="x int") == [2000, 8000, 10000, 10000]
    assert values(spark, catalog_edits.utf16_prefix(F.col("x"), F.lit(4)), "abcdef", "a😀😀", "ab. x", "") == ["abcd", "a😀", "ab", ""]
    assert values(spark, catalog_edits.sort_key(F.col("x")), " ガBき ", "abc") == ["ka bki ", "abc"]
    assert values(spark, T.token_prefix(F.col("x"), 3), "a b  c d", "1234567 x", "!!!!", "") == ["a b  c", "1234567", "!!!", ""]


def test_workers_hold_one_slice_at_a_time(spark):
    """Of a large batch no more than a slice is Python values at once, and none of its rows is lost."""
    import tracemalloc

    import pyarrow as pa

    class Units:  # gives what would run in a worker
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    def peak(run, batch):
        rows, most = [], 0
        tracemalloc.start()
        for made in run(iter([batch])):
            most = max(most, tracemalloc.get_traced_memory()[1])
            rows += [(a, b[:20] if isinstance(b, str) else b) for a, b in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True)]
            tracemalloc.reset_peak()
        tracemalloc.stop()
        return rows, most

    texts = [f"{i} **bold** " + "x" * (3000 if i else 9_000_000) for i in range(6000)]
    rows, most = peak(placeholders.protected(Units(), "markdown"), pa.record_batch([pa.array(range(6000)), pa.array(texts)], names=["doc_id", "text"]))
    assert rows == [(i, t.replace("**bold**", "<t1>bold</t1>")[:20]) for i, t in enumerate(texts)] and most < 60e6, most
    entry = {"id": "t1", "kind": "strong", "open": "**", "close": "**", "original": "", "place": ""}
    answers = pa.record_batch([pa.array(range(6000)), pa.array(["markdown"] * 6000), pa.array([[entry]] * 6000), pa.array([f"{i} < T 1 >bold</t1> " + "x" * 3000 for i in range(6000)])], names=["doc_id", "content_format", "entries", "answer"])
    rows, most = peak(placeholders.restored_answers(Units()), answers)
    assert rows == [(i, f"{i} **bold** {'x' * 20}"[:20]) for i in range(6000)] and most < 10e6, most
    assert placeholders.slices(iter([])) and not list(placeholders.slices(iter([answers.slice(0, 0)])))


def test_restored_answers(spark):
    text = "a **b** and `c` <x"
    source, entries = placeholders.protect_markdown(text)
    rows = [(1, "markdown", entries, source.replace("<t1>", "< T 一 >")), (2, "markdown", entries, "no tags"), (3, "plain-text", entries, source), (4, "markdown", [], "<t1>x"), (5, "markdown", entries, None)]
    kind = "array<struct<id string, kind string, open string, close string, original string, place string>>"
    got = {r.doc_id: (r.text, r.valid) for r in placeholders.restored_answers(spark.createDataFrame(rows, f"doc_id long, content_format string, entries {kind}, answer string")).collect()}
    assert got == {1: (text, True), 2: ("no tags", False), 3: (source, True), 4: ("<t1>x", True), 5: ("", False)}


def test_quota_and_window():
    quota = telemetry.Quota(2, 100)
    assert [quota.reserve(t, n) for t, n in ((0, 50), (10, 60), (20, 500), (30, 50), (59_990, 1), (60_000, 500), (60_001, 1))] == [0, 59_990, 59_980, 0, 25, 0, 59_999]
    window = telemetry.Window(4)
    assert [window.result(o) for o in ["success"] * 3 + ["rate_limited"] + ["headers", "success", "rate_limited", "success", "success"]] == [2, 2, 3, 1, 4, 4, 2, 2, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, 1000 * i, ["success", "success", "rate_limited", "headers"][(i * 7 + k) % 4]) for k in (1, 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "task_id long, event_id long, at long, outcome string").withColumn("ts", F.timestamp_millis("at")).withColumn("tokens", F.lit(5).cast("long")).drop("at")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    running = telemetry.aimd_stream(stream, 4).writeStream.format("memory").queryName("sizes").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    running.processAllAvailable()
    running.stop()
    as_set = lambda df: {tuple(r) for r in df.select("task_id", "event_id", "window_size").collect()}
    assert as_set(spark.table("sizes")) == as_set(telemetry.aimd_replay(frame, 4))
    counts = telemetry.live_statistics(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").start()
    counts.processAllAvailable()
    counts.stop()
    assert {r.task_id: r.total for r in spark.table("counts").collect()} == {1: 40, 2: 40}


def test_few_patterns_run_over_whole_texts(spark):
    from quillmill.functions import text as T

    texts = ["abc", "Latin text only", "かな と 漢字の文章です", "한국어 문장입니다 여기", "中文的句子在这里写着呢", "русский текст тут", "نص عربي هنا للتجربة", "đường phố rộng rãi", None, "", "1234 5678 -- !!", "naïve café déjà vu"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r[0] for r in frame.orderBy("id").select(T.detect_language(F.col("text"))).collect()]
    assert got == [None, "en", "ja", "ko", "zh-CN", "ru", "ar", "vi", None, None, None, "en"]
    plan = frame.select(T.detect_language(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text#") == 2
