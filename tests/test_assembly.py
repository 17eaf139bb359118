"""Pieces of answers, places and backgrounds against step by step forms."""

import random
import re
import time

from pyspark.sql import functions as F

from quillmill.functions import positions
from quillmill.operators import catalog, replacements, tasks

PIECES = "block long, sequence long, ord int, whole boolean, text string, nodes array<struct<node:int,text:string>>, node string"


def folded(pieces):
    """The pieces of a block one after the other: (whole, text, nodes)."""
    whole, text, nodes = pieces[0][0], "", {}
    for is_whole, own, by_node in pieces:
        if whole:
            text += (own or "") if is_whole else "".join(t or "" for _, t in sorted(by_node or []))
        elif is_whole:
            at = max(nodes, default=0)
            nodes[at] = nodes.get(at, "") + (own or "")
        else:
            for n, t in by_node or []:
                nodes[n] = nodes.get(n, "") + (t or "")
    return whole, text, nodes


def test_merging_against_a_fold(spark, monkeypatch):
    rng, rows, want = random.Random(3), [], {}
    for block in range(60):
        made = []
        for s in range(rng.randint(1, 9) if block else 400):  # one long block
            whole = rng.random() < 0.5
            nodes = None if rng.random() < 0.1 else [(n, rng.choice([f"{n}x{s} ", "", None])) for n in rng.sample(range(5), rng.randint(0, 4))]
            made.append((whole, f"w{s} " if rng.random() < 0.9 else None, nodes))
            rows.append((block, s // 2, s % 2, whole, made[-1][1], nodes, "clash"))
        want[block] = folded(made)
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, PIECES).repartition(5)
    for width in (replacements.WIDTH, 1 << replacements.BITS):
        monkeypatch.setattr(replacements, "WIDTH", width)
        got: dict = {}
        for r in replacements.merged(frame).collect():
            whole, text, nodes = got.get(r.block, (r.whole, "", {}))
            assert whole == r.whole
            got[r.block] = (whole, r.text, nodes) if r.whole else (whole, text, nodes if r.node is None else nodes | {r.node: r.text})
        assert got == want
    assert replacements.merged(frame.filter("false")).count() == 0


def test_pieces_and_nodes(spark):
    one = [("t1", 0), ("t2", 3)]
    cases = {
        "<t1>a</t1><t2>b\nc</t2>": (False, None, [(0, "a"), (3, "b\nc")]),
        "x < T2 >b</ t2 >y<t1></t1>": (False, None, [(0, ""), (3, "b")]),
        "<t1>a<t2>b</t2></t1>": (False, None, [(0, "a<t2>b</t2>"), (3, "b")]),
        "<t1>a</t1><t2>b</t2><t1>c</t1>": (True, "abc", None),
        "<t1>a</t1>b": (True, "ab", None),
        "<t1>a</t1><t2>b</t2><t9>c</t9>": (False, None, [(0, "a"), (3, "b")]),
        "": (True, "", None),
        None: (True, "", None),
    }
    rows = [(i, a, one) for i, a in enumerate(cases)] + [(90, "<t1>a</t1>", None), (91, "<a.b>q</a.b>", [("a.b", 1)]), (92, "<t1>a</t1><t2>b</t2>", [("t1", 4), ("t2", 4)])]
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id long, answer string, e array<struct<id:string,node:int>>").select("id", replacements.piece(F.col("answer"), F.col("e")).alias("p")).collect()}
    plain = lambda p: (p.whole, p.text, None if p.nodes is None else [tuple(n) for n in p.nodes])
    assert [plain(got[i]) for i in range(len(cases))] == list(cases.values())
    assert plain(got[90]) == (True, "a", None) and plain(got[91]) == (False, None, [(1, "q")]) and plain(got[92]) == (False, None, [(4, "b")])

    nodes = spark.createDataFrame([(b, n, f"{b}{n}") for b in (1, 2, 3, 4) for n in (0, 1)], "block long, node int, text string")
    pieces = spark.createDataFrame([(1, 0, 0, True, "W", None, ""), (2, 0, 0, False, None, [(1, "N")], ""), (3, 0, 0, False, None, [], "")], PIECES)
    shown = {(r.block, r.node): r.text for r in replacements.node_texts(nodes, replacements.merged(pieces)).collect()}
    assert shown == {(1, 0): "W", (1, 1): "", (2, 0): "", (2, 1): "N", (3, 0): "", (3, 1): "", (4, 0): "40", (4, 1): "41"}


def test_pieces_against_patterns(spark):
    """Random answers with side by side, nested, crossing, repeated, missing and odd tags against a search for each of them."""

    def want(answer, entries):
        if not entries:
            return True, re.sub(r"(?i)</?\s*t\d+\s*>", "", answer), None
        texts = {}
        for name, node in entries:
            found = re.findall(rf"(?is)<\s*{re.escape(name)}\s*>(.*?)<\s*/\s*{re.escape(name)}\s*>", answer)
            if len(found) != 1:
                return True, re.sub(r"(?i)</?\s*t\d+\s*>", "", answer), None
            texts.pop(node, None)
            texts[node] = found[0]
        return False, None, list(texts.items())

    rng, rows = random.Random(7), []
    for i in range(3000):
        ids = rng.sample(["t1", "t2", "t3", "t12", "T4", "a.b"], rng.randint(0, 4))
        tag = lambda n, close: "<" + rng.choice(["", " "]) + close + rng.choice(["", "\n"]) + rng.choice([n, n.upper()]) + rng.choice(["", " "]) + ">"
        if i % 3:
            answer = "".join(rng.choice(["", "x"]) + tag(n, "") + rng.choice(["", "é\n", "<b>"]) + tag(n, "/") for n in rng.sample(ids, len(ids)) + rng.choices(["t1", "t9"], k=rng.choice([0, 0, 1])))
        else:
            answer = "".join(rng.choice([tag(rng.choice(ids or ["t1"]), rng.choice(["", "/"])), "x", "\n"]) for _ in range(rng.randint(0, 9)))
        rows.append((i, answer, [(n, rng.randint(0, 3)) for n in ids]))
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id long, answer string, e array<struct<id:string,node:int>>").select("id", replacements.piece(F.col("answer"), F.col("e")).alias("p")).collect()}
    for i, answer, entries in rows:
        p = got[i]
        assert (p.whole, p.text, None if p.nodes is None else [tuple(n) for n in p.nodes]) == want(answer, entries), (answer, entries)


def test_many_tags_and_pieces_once(spark):
    """Many tags, one of them repeated; pieces are computed once for all that is read of them, and go by block once."""
    lines = F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.concat(F.lit("<T"), i, F.lit(" >one line of a text, "), i, F.lit("</ t"), i, F.lit(">")))
    entries = F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.struct(F.concat(F.lit("t"), i).alias("id"), i.alias("node")))
    rows = spark.range(2).select(F.col("id").alias("block"), F.concat(F.array_join(lines, ""), F.when(F.col("id") == 1, "<t7></t7>").otherwise("")).alias("answer"), entries.alias("e"))
    asked = rows.select("block", replacements.piece(F.col("answer"), F.col("e")).alias("p"))
    made = {r.block: r.p for r in asked.collect()}
    assert len(made[0].nodes) == 5000 and made[0].nodes[4999].text == "one line of a text, 5000" and made[1].whole
    pieces = rows.select("block", F.lit(0).alias("sequence"), F.lit(0).alias("ord"), replacements.piece(F.col("answer"), F.col("e")).alias("p")).select("block", "sequence", "ord", "p.*")
    nodes = spark.createDataFrame([(0, 2, "a"), (1, 0, "b"), (2, 0, "c")], "block long, node int, text string")
    shown = replacements.node_texts(nodes, replacements.merged(pieces))
    assert "regexp_extract_all" not in shown._jdf.queryExecution().optimizedPlan().toString()
    assert shown._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # texts of nodes go by block once
    assert [(r.block, r.text[:26], r.replaced) for r in shown.orderBy("block").collect()] == [(0, "one line of a text, 2", True), (1, "one line of a text, 1one l", True), (2, "c", False)]


def test_byte_offsets(spark):
    texts = {1: "aé\r\nß😀\n", 2: "", 3: "x\r", 4: None, 5: "\n" * 3000 + "zé"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = positions.line_index(docs).cache()
    for d, text in texts.items():
        raw, at, want = (text or "").encode(), 0, []
        for line in (text or "").encode().split(b"\n"):
            last = at + len(line) == len(raw)
            want.append((at, at + len(line) - (not last and line.endswith(b"\r"))))
            at += len(line) + 1
        assert [(r.start, r.end) for r in index.filter(f"doc_id = {d}").orderBy("line").collect()] == want
    asked = [(1, 1, c, a) for c in range(6) for a in (False, True)] + [(1, 2, 3, False), (1, 2, 4, False), (1, 2, 6, True), (1, 3, 1, False), (1, 3, 1, True), (1, 4, 1, False), (3, 1, 2, True), (5, 3001, 2, False), (9, 1, 1, False)]
    got = {tuple(r)[:4]: r.offset for r in positions.byte_offsets(spark.createDataFrame(asked, "doc_id long, line long, column long, after boolean"), index).collect()}
    first = {(c, a): got[1, 1, c, a] for c in range(6) for a in (False, True)}
    assert first == {(0, False): None, (0, True): None, (1, False): 0, (1, True): 1, (2, False): 1, (2, True): None, (3, False): None, (3, True): 3, (4, False): 3, (4, True): None, (5, False): None, (5, True): None}
    assert [got[k] for k in asked[12:]] == [7, None, 11, 12, None, None, 2, 3001, None]


def test_parts(spark):
    rows = ["[a](u)", "[a[b]c](u)", r"[a\]b](u)", "[a", "]a[", "![x](y)", "**b**", "***", "_c_", "", None, r"[\\](u)"]
    frame = spark.createDataFrame([(r,) for r in rows], "raw string")
    show = lambda c: [None if r[0] is None else tuple(r[0])[1:] for r in frame.select(c).collect()]
    assert show(positions.link_parts(F.col("raw"))) == [("[", "](u)", "a"), ("[", "](u)", "a[b]c"), ("[", "](u)", r"a\]b"), *[None] * 8, ("[", "](u)", r"\\")]
    assert show(positions.link_parts(F.col("raw"), image=True)) == [*[None] * 5, ("![", "](y)", "x"), *[None] * 6]
    assert show(positions.delimited_parts(F.col("raw"), "strong", ["**", "_"])) == [*[None] * 6, ("**", "**", "b"), None, ("_", "_", "c"), *[None] * 3]


def test_labels_of_any_depth(spark):
    """The closing bracket against a walk over the characters: deep, unclosed, escaped and long; a long text is walked by its brackets."""

    def walked(raw):
        depth, escaped = 0, False
        for i, c in enumerate(raw):
            if escaped or c == "\\":
                escaped = not escaped
            elif c in "[]":
                depth += 1 if c == "[" else -1
                if depth <= 0:
                    return i if depth == 0 else None

    rng = random.Random(11)
    rows = ["".join(rng.choice("[[[]]]\\\\aé😀\n") for _ in range(rng.randint(0, 24))) for _ in range(2000)]
    rows += ["[" + "a[b]" * 20_000 + "](u)", "[" * 3000 + "]" * 3000 + "x", "[" + "\\]" * 20_000 + "]", "[" * 5000, "\\", "[a\\"]
    frame = spark.createDataFrame(list(enumerate(rows)), "id int, raw string")
    got = {r.id: r.end for r in frame.select("id", positions.label_end(F.col("raw")).alias("end")).collect()}
    assert [got[i] for i in range(len(rows))] == [walked(r) for r in rows]
    # steps go by brackets, not by characters: eight million characters take a moment (by characters: minutes)
    start = time.monotonic()
    assert spark.createDataFrame([("[[[[" + "x" * 8_000_000 + "]]]](u)",)], "raw string").select(positions.link_parts(F.col("raw"))["close"]).first()[0] == "](u)"
    assert time.monotonic() - start < 10


def test_background(spark):
    rows = [(1, s, t) for s, t in enumerate([" a b ", " \n", "c\td", "e " * 3000])] + [(2, 0, " "), (2, 1, None), (3, 0, "x" * 50_000)] + [(4, s, "w") for s in range(3000)]
    chunks = spark.createDataFrame(rows, "id long, sequence long, source_text string").repartition(4)
    made = {r.id: r.background for r in tasks.global_background(chunks, "id").collect()}
    assert made == {1: "a b\n\nc\td\n\n" + " ".join(["e"] * 996), 2: "", 3: "x" * 50_000, 4: "\n\n".join(["w"] * 1000)}
    given = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, None), (4, True, ""), (5, True, None), (6, False, "k"), (7, True, "k")], "id long, enabled boolean, global_background string")
    got = {r.id: (r.global_background, r.used) for r in tasks.with_background(given, chunks, "id", 2).collect()}
    assert got == {1: ("a b", "a b"), 2: ("", None), 3: (None, None), 4: ("", None), 5: ("", None), 6: ("k", None), 7: ("k", "k")}


def test_capability_rules(spark):
    rules = [(1, "vision", "", "begins", "a.b"), (2, "video", "Vid", "holds", None), (3, "code", "co", "begins", "c.d"), (4, "other", None, "begins", "x.y"), (5, "late", "id", "holds", "")]
    table = spark.createDataFrame(rules, "rank int, capability string, pattern string, how string, host string").withColumn("host", F.nullif("host", F.lit("")))
    given = [("my-VIDEO", "https://z"), ("coder", "https://u:p@C.D:1/x"), ("coder", "https://e"), ("any", "http://A.B"), (None, None), ("id", "no url"), ("", "https://x.y")]
    got = {tuple(r)[:2]: r.capability for r in catalog.capabilities(spark.createDataFrame(given, "request_name string, base_url string"), table).collect()}
    assert [got[g] for g in given] == ["video", "code", "text", "vision", "text", "late", "other"]
    assert catalog.capabilities(spark.createDataFrame(given, "request_name string, base_url string"), table.filter("false")).filter("capability = 'text'").count() == len(given)


def test_rules_alike_meet_a_model_once(spark):
    rules = spark.range(20_000).select((20_000 - F.col("id")).alias("rank"), F.concat(F.lit("c"), 20_000 - F.col("id")).alias("capability"), F.when(F.col("id") % 2 == 0, "ed b").otherwise("").alias("pattern"), F.lit("holds").alias("how"), F.concat(F.lit("h"), F.col("id") % 3).alias("host"))
    given = spark.range(5000).select(F.concat("id", F.lit(" red bolt")).alias("request_name"), F.concat(F.lit("https://h"), F.col("id") % 4).alias("base_url"))
    for most_sent in (10, 300_000):  # rules in a shuffle, and sent
        made = catalog.capabilities(given, rules, most_sent=most_sent)
        assert {(r[0][-1], r[1], r[2]) for r in made.groupBy("base_url", "capability").count().collect()} == {("0", "c2", 1250), ("1", "c1", 1250), ("2", "c3", 1250), ("3", "text", 1250)}
    joined = catalog.capabilities(given, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in joined and "min(_order" in joined  # whole rules meet no model: 1667 a model otherwise
