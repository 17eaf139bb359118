"""Named queries over names that nothing else has, and over links that follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import catalog, naming, placeholders
from quillmill.runtime import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _given(rows: str, candidates: str, gone: str = "SELECT NULL::INT AS scope, NULL::VARCHAR AS name WHERE false") -> str:
    """SQL that gives names row by row: rows (scope, id, name), the candidates of a row, and what is gone already."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY id) AS n FROM ({rows})), g AS (SELECT scope, list(name) AS names FROM ({gone}) GROUP BY 1),
 a AS (SELECT DISTINCT r.scope, 0::BIGINT AS n, coalesce(g.names, []::VARCHAR[]) AS taken, NULL::BIGINT AS id, NULL::VARCHAR AS path FROM r LEFT JOIN g ON g.scope = r.scope
  UNION ALL SELECT c.scope, c.n, list_append(c.taken, c.path), c.id, c.path FROM (SELECT a.scope, a.n + 1 AS n, a.taken, r.id, list_filter({candidates}, lambda x: NOT list_contains(a.taken, x))[1] AS path FROM a JOIN r ON r.scope = a.scope AND r.n = a.n + 1) c)"""


_STEM = "CASE WHEN p_size % 10 = 0 THEN repeat('x', 230) || p_brand ELSE CASE p_partkey % 4 WHEN 0 THEN 'Brand' WHEN 1 THEN 'Brand-01' WHEN 2 THEN p_type ELSE '. ' END END"
_PLACE = "'/w/' || scope || '/' || coalesce(nullif(rtrim(left(name, 236 - length('/w/' || scope) - length(s)), ' .'), ''), 'task') || s || '.db'"


@query(f"""{_given(f"SELECT p_size AS scope, p_partkey AS id, {_STEM} AS name FROM part", f"list_transform(list_transform(range(0, 90), lambda k: CASE WHEN k = 0 THEN '' ELSE '-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k END), lambda s: {_PLACE.replace('scope', 'r.scope').replace('(name', '(r.name')})", "SELECT range AS scope, '/w/' || range || '/Brand-0' || unnest([1, 2, 3]) || '.db' AS name FROM range(1, 51) WHERE range % 2 = 0")}
 SELECT id AS p_partkey, path FROM a WHERE id IS NOT NULL""")
def database_paths(spark, sf_dir):
    """Database files in each size's folder: names that other names' suffixes hit, long ones, blank ones, and files that exist."""
    stem = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("x" * 230), "p_brand")).otherwise(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Brand' WHEN 1 THEN 'Brand-01' WHEN 2 THEN p_type ELSE '. ' END"))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/w/"), "p_size").alias("directory"), stem.alias("stem"), F.lit("task").alias("fallback"))
    there = load(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("/w/"), "p_size").alias("directory")).distinct()
    there = there.select("directory", F.explode(F.array(*(F.concat("directory", F.lit(f"/Brand-0{k}.db")) for k in (1, 2, 3)))).alias("name"))
    return naming.database_paths(rows, "directory", "stem", "fallback", "p_partkey", "db", there).select("p_partkey", "path")


_ASSET = "CASE p_partkey % 3 WHEN 0 THEN 'img/a.png' WHEN 1 THEN 'img/a-2.png' ELSE 'img.d/' || p_brand END"


@query(f"""{_given(f"SELECT p_size AS scope, p_partkey AS id, {_ASSET} AS name FROM part", "list_transform(range(1, 90), lambda k: 'assets/' || CASE WHEN k = 1 THEN r.name WHEN contains(r.name, '.png') THEN replace(r.name, '.png', '-' || k || '.png') ELSE r.name || '-' || k END)")}
 SELECT id AS p_partkey, path AS asset FROM a WHERE id IS NOT NULL""")
def unique_asset_paths(spark, sf_dir):
    """Assets of each size's document below one folder; a suffix may hit a name that is asked for too."""
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN './img/a.png' WHEN 1 THEN '/img//a-2.png' ELSE 'img.d\\\\\\\\' || p_brand END")
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_size", catalog.safe_asset(raw).alias("path"))
    return naming.asset_paths(rows, "p_size", "path", "p_partkey", "assets/").select("p_partkey", "asset")


@query("""SELECT p_partkey, '[x](a.png) ![y](' || p_brand || '/1.png "t") ![z]( ' || p_brand || '/1.png) ![w](' || p_brand || '/1.png) ![q](none.png) ![' || p_name || '](' || p_brand || '/1.png' || chr(9) || 't) ![open](' AS text FROM part""")
def relinked_assets(spark, sf_dir):
    """Images follow their files: titles, spaces, brackets, ./ and back slashes are seen through; links and unknown targets stay."""
    text = F.concat(F.lit('[x](a.png) ![y](a.png "t") ![z]( ./a.png) ![w](<a.png>) ![q](none.png) !['), "p_name", F.lit("](.\\a.png\tt) ![open]("))
    docs = load(spark, sf_dir, "part").select("p_partkey", text.alias("text"), "p_brand")
    moves = docs.select("p_partkey", F.lit("a.png").alias("old"), F.concat("p_brand", F.lit("/1.png")).alias("new"))
    return placeholders.relinked(docs, moves, "p_partkey").select("p_partkey", "text")
