"""Queries of the training-data operators, with the SQL to hold them against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, chat, dedup, divergence, maxent, merkle, neighbours, packing, pii, quality, sharding, token_files, toxicity, vocab
from quillmill.runtime import load, scratch_dir


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), vocab.default_path("byte_bpe_50k.json"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.own_pairs(load(spark, sf_dir, "conversations")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.link(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), vocab.default_path("byte_bpe_50k.json"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(load(spark, sf_dir, "documents"), path, vocab.default_path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(load(spark, sf_dir, "documents"))
    figures = {f"q_{n}": n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return judged.withColumnsRenamed(figures).select("doc_id", *figures.values(), "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(load(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = op1_packing, op2_preferences, op3_near_dedup, op4_sharding, op5_bpe, op6_neighbours, op7_pii, op8_toxicity, op9_token_files, op10_quality, op11_divergence, op12_language_model, op13_merkle
    return {f.__name__: f for f in every}


_RENDER = "'<|' || t.role || '|>' || chr(10) || t.text || chr(10)"
_SPANS = """list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN (list_sum(list_transform({0}[1:i - 1], lambda u: length(u.role) + length(u.text) + 6)) + length({0}[i].role) + 5)::BIGINT || ':' || (list_sum(list_transform({0}[1:i - 1], lambda u: length(u.role) + length(u.text) + 6)) + length({0}[i].role) + 5 + length({0}[i].text))::BIGINT END)"""


def _spans(c: str) -> str:
    spans = _SPANS.format(c).replace("list_sum(", "coalesce(list_sum(").replace("+ 6)) +", "+ 6)), 0) +")
    return f"array_to_string(list_filter({spans}, lambda x: x IS NOT NULL), ',')"


def _text(c: str) -> str:
    return f"coalesce(array_to_string(list_transform({c}, lambda t: {_RENDER}), ''), '')"


PREFERENCES = f"""WITH t AS (SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS chosen FROM conversations GROUP BY 1),
 p AS (SELECT *, list_filter(range(1, len(chosen) + 1), lambda i: chosen[i].role = 'assistant') AS pl FROM t),
 r AS (SELECT conv_id, chosen, CASE WHEN len(pl) = 0 THEN chosen ELSE list_transform(chosen, lambda x, i: CASE WHEN i = pl[-1] THEN {{'turn': x.turn, 'role': x.role, 'text': CASE WHEN len(pl) = 1 THEN '' ELSE chosen[pl[1]].text END}} ELSE x END) END AS rejected FROM p),
 k AS (SELECT *, coalesce(list_min(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i].role <> rejected[i].role OR chosen[i].text <> rejected[i].text)) - 1, len(chosen)) AS n FROM r),
 q AS (SELECT conv_id, n, chosen[1:n] AS a, chosen[n + 1:] AS c, rejected[n + 1:] AS d FROM k)
 SELECT conv_id, n::BIGINT AS prompt_turns, {_text('a')} AS prompt, {_text('c')} AS chosen, {_text('d')} AS rejected, {_spans('c')} AS chosen_mask, {_spans('d')} AS rejected_mask FROM q"""

NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
 l2 AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l2.y, c.root FROM c JOIN l2 ON l2.x = c.doc_id)
 SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM c JOIN n USING (doc_id) GROUP BY doc_id, n"""

QUALITY = r"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 o AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM o) GROUP BY 1),
 l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
 f AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
 r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  (n_symbols > 0.1 * greatest(n_words, 1))::INT + (n_dup_lines > 0.3 * greatest(n_lines, 1))::INT + (word_chars::DOUBLE / greatest(n_words, 1) < 3 OR word_chars::DOUBLE / greatest(n_words, 1) > 12)::INT AS more FROM f),
 h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR more > 0) AS k FROM r GROUP BY 1),
 m AS (SELECT avg(k::DOUBLE / n) AS m, var_pop(k::DOUBLE / n) AS v, avg(1.0::DOUBLE / n) AS noise FROM h),
 b AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, 1e-6) - 1, 1.0) AS strength FROM m),
 q AS (SELECT source, (k + m * strength) / (n + strength) AS rate FROM h, b)
 SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND more < CASE WHEN rate >= 0.5 THEN 1 ELSE 2 END AS kept, round(rate, 6) AS host_rate FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source"""


DIVERGENCE = r"""WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id FROM documents),
 w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
 v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY 1),
 c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 g AS (SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_n), 0) AS lang_n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON v.lang = d.lang GROUP BY 1, 2),
 t AS (SELECT g.*, coalesce(s.n, 0) AS n FROM g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s ON s.lang = g.lang AND s.source = g.source),
 p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.n + 2 * t.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (t.lang_n + 2 * t.v)::HUGEINT AS q
  FROM t JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
 SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10"""

_VALUE = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
MERKLE = f"""WITH RECURSIVE l AS (SELECT doc_id, lang, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text=_LOW)} ELSE {_LEAF.format(text="text")} END AS found FROM documents),
 o AS (SELECT *, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
 t AS (SELECT tree, 0 AS level, idx, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM o
  UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY tree, level, idx // 8),
 s AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx FROM t WHERE n = 1),
 u AS (SELECT 0 AS level, idx, subroot AS node, count(*) OVER () AS n FROM s
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY level, idx // 8),
 a AS (SELECT o.tree, o.idx, t.level, coalesce(string_agg(t.node, '' ORDER BY t.idx) FILTER (t.idx < o.idx // pow(8, t.level)::BIGINT), '') AS le, coalesce(string_agg(t.node, '' ORDER BY t.idx) FILTER (t.idx > o.idx // pow(8, t.level)::BIGINT), '') AS ri
  FROM o JOIN t ON t.tree = o.tree AND t.n > 1 AND t.idx // 8 = o.idx // pow(8, t.level + 1)::BIGINT GROUP BY 1, 2, 3
  UNION ALL SELECT o.tree, o.idx, 100 + u.level, coalesce(string_agg(u.node, '' ORDER BY u.idx) FILTER (u.idx < s.idx // pow(8, u.level)::BIGINT), ''), coalesce(string_agg(u.node, '' ORDER BY u.idx) FILTER (u.idx > s.idx // pow(8, u.level)::BIGINT), '')
  FROM o JOIN s ON s.tree = o.tree JOIN u ON u.n > 1 AND u.idx // 8 = s.idx // pow(8, u.level + 1)::BIGINT GROUP BY 1, 2, 3),
 p AS (SELECT tree, idx, string_agg(le || ri, '' ORDER BY level) AS proof, list(le || ',' || ri ORDER BY level) AS path FROM a GROUP BY 1, 2),
 f AS (SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(found, coalesce(path, [])), lambda x, y: sha256(split_part(y, ',', 1) || x || split_part(y, ',', 2))) AS folded_root FROM o JOIN s ON s.tree = o.tree LEFT JOIN p ON p.tree = o.tree AND p.idx = o.idx)
 SELECT *, folded_root = root AS verified FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op2_preferences": PREFERENCES, "op3_near_dedup": NEAR, "op10_quality": QUALITY, "op11_divergence": DIVERGENCE, "op13_merkle": MERKLE}
