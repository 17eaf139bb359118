"""Named queries over pieces of answers that become texts of nodes, places in texts, and backgrounds of tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import positions
from quillmill.functions import text as T
from quillmill.operators import replacements, tasks
from quillmill.runtime import Scratch, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_NONE = "[]::STRUCT(node BIGINT, text VARCHAR)[]"
_BOTH = "list_transform(list_sort(list_distinct(list_concat(list_transform(s.nodes, lambda x: x.node), list_transform(p.nodes, lambda x: x.node)))), lambda i: {'node': i, 'text': coalesce(list_filter(s.nodes, lambda x: x.node = i)[1].text, '') || coalesce(list_filter(p.nodes, lambda x: x.node = i)[1].text, '')})"
_ALL = "coalesce(array_to_string(list_transform(p.nodes, lambda x: x.text), ''), '')"


@query(f"""WITH RECURSIVE p AS (SELECT conv_id AS block, turn AS sequence, (conv_id * 5 + turn * 3) % 4 = 0 AS whole, text,
  CASE WHEN conv_id % 6 = 1 AND turn < 2 THEN {_NONE} ELSE list_transform(string_split(text, chr(10)), lambda x, i: {{'node': 2 * (i - 1) + turn % 3, 'text': x}}) END AS nodes FROM conversations),
 r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY sequence) AS n FROM p),
 s AS (SELECT block, 1::BIGINT AS n, whole, CASE WHEN whole THEN text ELSE '' END AS text, CASE WHEN whole THEN {_NONE} ELSE nodes END AS nodes FROM r WHERE n = 1
  UNION ALL SELECT s.block, s.n + 1, s.whole, CASE WHEN s.whole THEN s.text || CASE WHEN p.whole THEN p.text ELSE {_ALL} END ELSE '' END,
   CASE WHEN s.whole THEN {_NONE} WHEN NOT p.whole THEN {_BOTH} WHEN len(s.nodes) = 0 THEN [{{'node': 0::BIGINT, 'text': p.text}}]
    ELSE list_transform(s.nodes, lambda x, i: {{'node': x.node, 'text': x.text || CASE WHEN i = len(s.nodes) THEN p.text ELSE '' END}}) END FROM s JOIN r p ON p.block = s.block AND p.n = s.n + 1),
 e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY n DESC) = 1)
 SELECT block, whole, NULL::INT AS node, text FROM e WHERE whole UNION ALL SELECT block, whole, x.node::INT, x.text FROM (SELECT block, whole, unnest(nodes) AS x FROM e WHERE NOT whole)""")
def replacement_merge(spark, sf_dir):
    """Turns of a conversation as pieces of a block: whole ones, and such by node, lines being nodes."""
    talks = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("block"), F.col("turn").alias("sequence"), F.lit(0).alias("ord"), "text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((2 * i + F.col("sequence") % 3).cast("int").alias("node"), x.alias("text")))
    empty = (F.col("block") % 6 == 1) & (F.col("sequence") < 2)
    pieces = talks.withColumn("whole", (F.col("block") * 5 + F.col("sequence") * 3) % 4 == 0).withColumn("nodes", F.when(empty, F.array().cast(replacements.NODES)).otherwise(lines))
    return replacements.merged(pieces).filter("whole or node is not null")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS node, len(string_split(text, chr(10))) AS n FROM documents),
 w AS (SELECT doc_id, string_agg('[' || line || ']', '' ORDER BY node) AS whole FROM l GROUP BY 1)
 SELECT doc_id AS block, node::INT AS node, CASE doc_id % 4 WHEN 0 THEN '[' || line || ']' WHEN 1 THEN CASE WHEN n = 1 THEN line WHEN node = 0 THEN whole ELSE '' END
  WHEN 2 THEN '[' || line || ']' || CASE WHEN node = n - 1 THEN '!' ELSE '' END ELSE line END AS text, NOT (doc_id % 4 = 3 OR (doc_id % 4 = 1 AND n = 1)) AS replaced FROM l JOIN w USING (doc_id)""")
def node_replacements(spark, sf_dir):
    """Lines of documents as nodes, and answers with a tag a line: whole ones, one tag twice, a whole piece after it, none."""
    docs = load(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("block"), F.split("text", "\n").alias("lines"))
    entries = F.transform("lines", lambda x, i: F.struct(F.concat(F.lit("t"), i + 1).alias("id"), i.alias("node")))
    tagged = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("<T"), i + 1, F.lit(" >["), x, F.lit("]</ t"), i + 1, F.lit(">"))), "")
    twice = F.concat(tagged, F.lit("<t1></t1>"))
    kind = F.col("block") % 4
    # of a repeated tag nothing is taken by node; as its text is empty, only tags go from the whole
    answers = docs.filter((kind < 3) & ~((kind == 1) & (F.size("lines") == 1))).select("block", F.when(kind == 1, F.regexp_replace(twice, "</ ", "</")).otherwise(tagged).alias("answer"), entries.alias("entries"))
    first = answers.select("block", F.lit(0).alias("sequence"), F.lit(0).alias("ord"), replacements.piece(F.col("answer"), F.col("entries")).alias("p")).select("block", "sequence", "ord", "p.*")
    later = docs.filter(kind == 2).select("block", F.lit(1).alias("sequence"), F.lit(0).alias("ord"), replacements.piece(F.lit("!<t1>"), F.lit(None).cast("array<struct<id:string,node:int>>")).alias("p")).select("block", "sequence", "ord", "p.*")
    nodes = docs.select("block", F.posexplode("lines").alias("node", "text"))
    scratch = Scratch(spark)
    return replacements.node_texts(nodes, replacements.merged(first.unionByName(later), scratch), scratch)


_CUT = "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END"


@query(f"""WITH t AS (SELECT doc_id, string_split({_CUT}, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line, len(ls) AS n FROM t),
 b AS (SELECT doc_id, line, CASE WHEN line < n AND raw LIKE '%' || chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS content, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
 p AS (SELECT doc_id, line + doc_id % 2 AS line, ((doc_id * 7 + line * 13) % 90)::BIGINT AS "column", line % 2 = 1 AS after FROM b)
 SELECT p.doc_id, p.line, p."column", p.after, CASE WHEN p."column" > 0 AND list_contains(list_transform(range(0, length(b.content) + 1), lambda c: strlen(left(b.content, c))), p."column" - CASE WHEN p.after THEN 0 ELSE 1 END) THEN b.start + p."column" - CASE WHEN p.after THEN 0 ELSE 1 END END AS "offset"
 FROM p LEFT JOIN b ON b.doc_id = p.doc_id AND b.line = p.line""")
def markdown_byte_offsets(spark, sf_dir):
    """Bytes of a place in each line: inside characters, beyond lines and beyond texts, too; every third text has carriage returns."""
    docs = load(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    docs = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")).alias("text"))
    index = positions.line_index(docs)
    places = index.select("doc_id", (F.col("line") + F.col("doc_id") % 2).alias("line"), ((F.col("doc_id") * 7 + F.col("line") * 13) % 90).alias("column"), (F.col("line") % 2 == 1).alias("after"))
    return positions.byte_offsets(places, index)


_MARKED = """CASE (doc_id + k) % 7 WHEN 0 THEN '[' || line || '](u)' WHEN 1 THEN '![' || replace(line, 'a', '[a]') || '](u "t")' WHEN 2 THEN '[' || replace(line, 'e', '\\]') || '](u)' WHEN 3 THEN '**' || line || '**'
 WHEN 4 THEN '[' || replace(line, 'a', '[') || ']' WHEN 5 THEN '_' || line || '_' ELSE CASE WHEN doc_id % 2 = 0 THEN '***' ELSE '[' || line || '\\\\](x)' END END"""


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), m AS (SELECT doc_id, k, {_MARKED} AS raw FROM l),
 h AS (SELECT doc_id, k, raw, CASE WHEN starts_with(raw, '![') THEN 'image' WHEN starts_with(raw, '[') THEN 'link' END AS kind, CASE WHEN starts_with(raw, '![') THEN '![' ELSE '[' END AS head FROM m),
 c AS (SELECT doc_id, k, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, k, string_split(regexp_replace(raw, '\\\\.', 'xx', 'gs'), '') AS cs FROM h WHERE kind IS NOT NULL)),
 d AS (SELECT *, sum(CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY i) AS depth FROM c), e AS (SELECT doc_id, k, min(i) AS i FROM d WHERE c = ']' AND depth = 0 GROUP BY 1, 2),
 x AS (SELECT h.doc_id, h.k, CASE WHEN i IS NOT NULL THEN kind WHEN kind IS NULL AND length(raw) >= 2 * length(q) THEN 'emphasis' END AS kind,
  CASE WHEN i IS NOT NULL THEN head WHEN kind IS NULL AND length(raw) >= 2 * length(q) THEN q END AS opening, CASE WHEN i IS NOT NULL THEN substr(raw, i) WHEN kind IS NULL AND length(raw) >= 2 * length(q) THEN q END AS closing,
  CASE WHEN i IS NOT NULL THEN raw[length(head) + 1:i - 1] WHEN kind IS NULL AND length(raw) >= 2 * length(q) THEN raw[length(q) + 1:length(raw) - length(q)] END AS inner_text
  FROM (SELECT *, CASE WHEN raw LIKE '**%**' THEN '**' WHEN raw[1] = '_' THEN '_' END AS q FROM h) h LEFT JOIN e ON e.doc_id = h.doc_id AND e.k = h.k)
 SELECT doc_id, k::BIGINT AS line, kind, opening, closing, inner_text FROM x""")
def inline_parts(spark, sf_dir):
    """Lines as links and images with nested, escaped and missing brackets, and in delimiters: what each is made of."""
    docs = load(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    line, which = F.col("line"), (F.col("doc_id") + F.col("line_no")) % 7
    wrap = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    swap = lambda a, b: F.replace("line", F.lit(a), F.lit(b))
    forms = [wrap("[", line, "](u)"), wrap("![", swap("a", "[a]"), '](u "t")'), wrap("[", swap("e", "\\]"), "](u)"), wrap("**", line, "**"), wrap("[", swap("a", "["), "]"), wrap("_", line, "_")]
    raw = F.when(F.col("doc_id") % 2 == 0, "***").otherwise(wrap("[", line, "\\\\](x)"))
    for k, form in enumerate(forms):
        raw = F.when(which == k, form).otherwise(raw)
    parts = lambda r: F.coalesce(positions.link_parts(r, image=True), positions.link_parts(r), positions.delimited_parts(r, "emphasis", ["**", "_"]))
    made = lines.select("doc_id", F.col("line_no").cast("long").alias("line"), T.once(raw, parts).alias("p"))
    return made.select("doc_id", "line", F.col("p.kind").alias("kind"), F.col("p.open").alias("opening"), F.col("p.close").alias("closing"), F.col("p.inner").alias("inner_text"))


_TASKS = "SELECT DISTINCT conv_id, conv_id % 5 <> 4 AS enabled, CASE conv_id % 5 WHEN 1 THEN 'kept ' || conv_id WHEN 2 THEN ' ' END AS cached FROM conversations"


@query(f"""WITH k AS ({_TASKS}), g AS (SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 THEN ' ' ELSE trim(text, ' ' || chr(10)) END AS text FROM conversations), n AS (SELECT *, len(regexp_extract_all(text, '{T.TOKEN}')) AS tokens FROM g WHERE trim(text) <> ''),
 b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n), j AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM b WHERE before < 150 GROUP BY 1),
 m AS (SELECT conv_id, rtrim(regexp_extract(text, '^(?:\\s*(?:{T.TOKEN})){{0,150}}', 0), ' ' || chr(10)) AS made FROM j), s AS (SELECT conv_id, enabled, coalesce(cached, CASE WHEN enabled THEN coalesce(made, '') END) AS global_background FROM k LEFT JOIN m USING (conv_id))
 SELECT conv_id, enabled, global_background, CASE WHEN enabled AND trim(global_background) <> '' THEN global_background END AS used FROM s""")
def global_background_texts(spark, sf_dir):
    """Backgrounds of conversations: made, stored before, stored as empty, of blank turns alone, and not asked for."""
    talks = load(spark, sf_dir, "conversations")
    chunks = talks.select("conv_id", F.col("turn").alias("sequence"), F.when(F.col("conv_id") % 10 == 3, " ").otherwise(F.col("text")).alias("source_text"))
    kind = F.col("conv_id") % 5
    given = talks.select("conv_id").distinct().select("conv_id", (kind != 4).alias("enabled"), F.when(kind == 1, F.concat(F.lit("kept "), "conv_id")).when(kind == 2, " ").alias("global_background"))
    return tasks.with_background(given, chunks, "conv_id", 150)
