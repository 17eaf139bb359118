"""Names that nothing else has, given at once, against giving them row by row; links of images."""

import random

from pyspark.sql import functions as F
from quillmill.operators import naming, placeholders


def one_by_one(rows, name, existing=()):
    taken, out = set(existing), {}
    for scope, order, base in sorted(rows, key=lambda r: r[1]):
        k = 0
        while (scope, name(scope, base, k)) in taken:
            k += 1
        out[order] = name(scope, base, k)
        taken.add((scope, out[order]))
    return out


def path_of(scope, stem, k, limit=240):
    suffix = "" if k == 0 else f"-{k:02}"
    fit = lambda s: s.encode("utf-16-le")[: 2 * (limit - len(scope) - 4 - len(suffix))].decode("utf-16-le", "ignore").rstrip(" .")
    return f"{scope}/{fit(stem) or 'task'}{suffix}.db"


def database_paths(spark, rows, existing=()):
    df = spark.createDataFrame([(*r, "task") for r in rows], "directory string, n long, stem string, fallback string")
    there = spark.createDataFrame(list(existing), "directory string, name string") if existing else None
    return {r.n: r.path for r in naming.database_paths(df, "directory", "stem", "fallback", "n", "db", there).collect()}


def test_names_that_suffixes_hit(spark):
    long = "y" * 250
    rows = [("/w", 0, "a"), ("/w", 1, "a"), ("/w", 2, "a-01"), ("/w", 3, long + "1"), ("/w", 4, long + "2"), ("/w", 5, " ."), ("/w", 6, "a-01"), ("/v", 7, "a"), ("/w", 8, "😀" * 130), ("/w", 9, "😀" * 140)]
    got = database_paths(spark, rows)
    assert [got[k] for k in (0, 1, 2, 6, 7, 5)] == ["/w/a.db", "/w/a-01.db", "/w/a-01-01.db", "/w/a-01-02.db", "/v/a.db", "/w/task.db"]
    assert len(set(got.values())) == len(rows) and all(len(p.encode("utf-16-le")) // 2 <= 240 for p in got.values())
    assert got == one_by_one(rows, path_of)
    assert got[3] == "/w/" + "y" * 234 + ".db" and got[4] == "/w/" + "y" * 231 + "-01.db"


def test_existing_names_and_chains(spark):
    existing = [("/w", f"/w/a{s}.db") for s in ["", *(f"-{k:02}" for k in range(1, 40))]] + [("/w", "/w/b.db"), ("/v", "/v/a.db")]
    rows = [("/w", k, "a") for k in range(4)] + [("/w", 9, "a-41"), ("/w", 5, "b"), ("/v", 6, "a"), ("/w", 7, "b-01"), ("/w", 8, "b")]
    got = database_paths(spark, rows, existing)
    assert got == one_by_one(rows, path_of, existing)
    assert got[0] == "/w/a-40.db"


def test_random_names(spark):
    rng = random.Random(6)
    stems = ["a", "a-01", "a-02", "a-01-01", "b", "b-01", "x" * 236, "x" * 233 + "-01", "x" * 240]
    rows = [(rng.choice(["/w", "/v"]), k, rng.choice(stems)) for k in rng.sample(range(1000), 150)]
    existing = [("/w", "/w/a-03.db"), ("/w", "/w/b.db"), ("/v", "/v/a-01-01.db")]
    assert database_paths(spark, rows, existing) == one_by_one(rows, path_of, existing)


def test_no_room_and_no_rows(spark):
    assert database_paths(spark, [("/" + "d" * 240, 1, "a"), ("/w", 2, "a")]) == {1: None, 2: "/w/a.db"}
    assert database_paths(spark, []) == {}


def test_assets(spark):
    rows = [(1, 0, "a.png"), (1, 1, "a.png"), (1, 2, "a-2.png"), (2, 3, "a.png"), (1, 4, "d.x/f"), (1, 5, "d.x/f"), (1, 6, None)]
    df = spark.createDataFrame(rows, "doc long, n long, path string")
    got = {r.n: r.asset for r in naming.asset_paths(df, "doc", "path", "n", "s/").collect()}
    assert got == {0: "s/a.png", 1: "s/a-2.png", 2: "s/a-2-2.png", 3: "s/a.png", 4: "s/d.x/f", 5: "s/d.x/f-2", 6: None}


def test_images_follow_their_files(spark):
    texts = ['![y](a.png "t") ![z](./a.png) ![w](<a.png>) [x](a.png)', "![a](\ta.png)![](b\\c.png)![ ]( <b/c.png> 't')", "![open](a.png", "no image (a.png)", None, "", "![x] y](a.png) ![n](none)", "![a](././a.png\n'x')"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moves = spark.createDataFrame([(k, o, n) for k in range(8) for o, n in (("a.png", "1/$0.png"), ("b/c.png", "2.png"), ("a.png", "1/$0.png"))], "doc_id long, old string, new string")
    got = {r.doc_id: r.text for r in placeholders.relinked(docs, moves).collect()}
    assert got == {
        0: '![y](1/$0.png "t") ![z](1/$0.png) ![w](1/$0.png) [x](a.png)', 1: "![a](\t1/$0.png)![](2.png)![ ]( 2.png 't')", 2: texts[2], 3: texts[3], 4: None, 5: "",
        6: "![x] y](1/$0.png) ![n](none)", 7: "![a](1/$0.png\n'x')",
    }
    assert placeholders.relinked(docs, moves.filter("false")).filter(F.col("doc_id") == 0).first().text == texts[0]


def test_lost_code_is_no_broken_tag(spark):
    entries = [{"id": "t1", "kind": "code", "open": "", "close": "", "original": "`x`", "place": ""}, {"id": "t2", "kind": "strong", "open": "**", "close": "**", "original": "", "place": ""}]
    assert placeholders.restoring("<t2>a</t2>", entries) == ("**a**", True)
    assert placeholders.restoring("<t1></t1> <t2>a", entries) == ("`x` a", False)
