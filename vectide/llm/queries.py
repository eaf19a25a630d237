"""The queries of this subpackage, by name, and their SQL for the comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table as t
from . import clustering, imi, leakage, markup, neardup, packing, quality, splitting, truncation


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean(t(spark, d, "wiki_chunks")).select("id", "clean_text", F.size("blocks").alias("n_blocks"), "marked")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(t(spark, d, "wiki_chunks")).select("id", "piece_index", F.length("piece").alias("n_chars"), "overlap_chars", "piece")


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The own parts of each text's pieces put together again; a text has few pieces."""
    own = splitting.split_chunks(t(spark, d, "wiki_chunks")).select("id", "piece_index", F.expr("substring(piece, overlap_chars + 1)").alias("own"), F.length("piece").alias("n"))
    joined = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece_index", "own"))).alias("p"), F.max("n").alias("longest"))
    whole = F.concat_ws("", F.transform("p", lambda x: x["own"]))
    return joined.select("id", F.length(whole).cast("long").alias("n_chars"), F.md5(whole).alias("digest"), (F.col("longest") <= splitting.LIMIT).alias("within"))


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.scored(t(spark, d, "wiki_chunks"), t(spark, d, "common_words"))
    return rows.select("id", "lang", F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: markup.found(t(s, d, "wiki_chunks")),
    "p1_clean": p1_clean,
    "p2_found": lambda s, d: splitting.oversized(t(s, d, "wiki_chunks")),
    "p2_pieces": p2_pieces,
    "p2_rejoined": p2_rejoined,
    "p4_method": lambda s, d: clustering.clusters(t(s, d, "wiki_vec")),
    "p4_found": lambda s, d: clustering.found(t(s, d, "wiki_vec")),
    "p5_method": p5_method,
    "p5_found": lambda s, d: quality.found(t(s, d, "wiki_chunks"), t(s, d, "common_words")),
    "p5_stats": lambda s, d: quality.stats(t(s, d, "wiki_chunks"), t(s, d, "common_words")),
    "p6_found": lambda s, d: imi.found(t(s, d, "wiki_vec")),
    "p6_neighbours": lambda s, d: imi.neighbours(t(s, d, "wiki_vec"), every=20),
    "p7_found": lambda s, d: neardup.found(t(s, d, "wiki_chunks")),
    "p7_groups": lambda s, d: neardup.groups(t(s, d, "wiki_chunks")),
    "p8_containers": lambda s, d: packing.pack(t(s, d, "documents")),
    "p8_fill": lambda s, d: packing.fill(packing.pack(t(s, d, "documents"))),
    "p9_found": lambda s, d: leakage.found(t(s, d, "documents"), t(s, d, "eval_items")),
    "p9_documents": lambda s, d: leakage.documents_touched(t(s, d, "documents"), t(s, d, "eval_items")),
    "p10_method": lambda s, d: truncation.method(t(s, d, "documents"), t(s, d, "common_words")),
    "p10_found": lambda s, d: truncation.found(t(s, d, "documents"), t(s, d, "common_words")),
    "p10_rates": lambda s, d: truncation.rates(t(s, d, "documents"), t(s, d, "common_words")),
}

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_USABLE = """usable AS (
  SELECT rowid, any_value(vector)::DOUBLE[] AS v FROM (SELECT "rowid" AS rowid, vector FROM wiki_vec) x
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY 1)"""

_STATS = f"""
c AS (SELECT DISTINCT id, content FROM wiki_chunks WHERE content IS NOT NULL AND id IS NOT NULL),
w AS (SELECT id, {_WORDS.format('content')} AS ws, list_filter(string_split(content, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '') AS ls,
  length(regexp_replace(content, '\\s', '', 'g')) AS solid, length(regexp_replace(content, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS signs FROM c),
l AS (SELECT lang, list(lower(word)) AS known FROM common_words GROUP BY lang),
g AS (SELECT id, lang, len(list_filter(ws, lambda x: list_contains(known, x))) AS hits FROM w, l),
h AS (SELECT id, max(hits) AS hits, coalesce(min(lang) FILTER (hits > 0 AND hits = top), '') AS lang FROM (SELECT *, max(hits) OVER (PARTITION BY id) AS top FROM g) x GROUP BY id),
s AS (SELECT id, lang, len(ls) AS n_lines, len(ws)::INTEGER AS n_words,
  CASE WHEN len(ws) = 0 THEN 0 ELSE list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE / len(ws) END AS mean_word_len,
  CASE WHEN solid = 0 THEN 0 ELSE signs::DOUBLE / solid END AS symbol_share,
  CASE WHEN len(ls) = 0 THEN 0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;…]["\'\'”’»)\\]]*\\s*$')))::DOUBLE / len(ls) END AS punct_line_share,
  CASE WHEN len(ws) = 0 THEN 0 ELSE hits::DOUBLE / len(ws) END AS common_share
  FROM w JOIN h USING (id))"""


def _similar_sql(size: int, least: str) -> str:
    """Pairs of chunks whose sets of word shingles are similar, as a table ``alike`` (id_a, id_b)."""
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(size))
    return f"""
c AS (SELECT id, any_value(content) AS content FROM wiki_chunks WHERE content IS NOT NULL GROUP BY id),
w AS (SELECT id, {_WORDS.format('content')} AS ws FROM c),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - {size - 2}), lambda i: {gram})) AS sh FROM w WHERE len(ws) >= {size}),
k AS (SELECT id, count(*) AS n FROM g GROUP BY id),
b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS shared FROM g x JOIN g y ON x.sh = y.sh AND x.id < y.id GROUP BY 1, 2),
alike AS (SELECT id_a, id_b FROM b JOIN k p ON p.id = id_a JOIN k q ON q.id = id_b WHERE shared >= {least} * (p.n + q.n - shared))"""


SQL: dict[str, str] = {
    "p2_rejoined": "SELECT id, length(any_value(content)) AS n_chars, md5(any_value(content)) AS digest, true AS within FROM wiki_chunks WHERE content IS NOT NULL GROUP BY id",
    "p2_found": "SELECT DISTINCT id FROM wiki_chunks WHERE length(content) > 1200",
    "p5_stats": f"""WITH {_STATS}
SELECT id, n_words, round(mean_word_len, 6) AS mean_word_len, round(symbol_share, 6) AS symbol_share, round(punct_line_share, 6) AS punct_line_share, round(common_share, 6) AS common_share FROM s""",
    "p5_method": f"""WITH {_STATS},
v AS (SELECT id, CASE WHEN lang = '' THEN 'en' ELSE lang END AS lang, unnest(list_zip(['both', 'both', 'high', 'low', 'low'], [n_words, mean_word_len, symbol_share, punct_line_share, common_share])) AS z FROM s WHERE n_lines > 0),
o AS (SELECT id, lang, z[1] AS side, z[2] AS value, row_number() OVER () AS r FROM v),
p AS (SELECT *, (r - 1) % 5 AS stat FROM (SELECT id, lang, side, value, row_number() OVER (PARTITION BY id ORDER BY r) AS r FROM o) x),
e AS (SELECT id, side, (rank() OVER (PARTITION BY lang, stat ORDER BY value) - 1)::DOUBLE / count(*) OVER (PARTITION BY lang, stat) AS below,
  count(*) OVER (PARTITION BY lang, stat ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / count(*) OVER (PARTITION BY lang, stat) AS upto FROM p),
q AS (SELECT id, CASE side WHEN 'low' THEN upto WHEN 'high' THEN 1 - below ELSE least(1.0, 2 * least(upto, 1 - below)) END AS tail FROM e)
SELECT id, lang, round(sum(greatest(0, -ln(tail) - 1)), 6) AS score FROM q JOIN s USING (id) GROUP BY id, lang""",
    "p6_found": f"""
WITH {_USABLE},
n AS (SELECT rowid, list_transform(v, lambda e: e / sqrt(list_sum(list_transform(v, lambda f: f * f)))) AS u FROM usable),
s AS (SELECT a.rowid AS a, b.rowid AS b, list_inner_product(a.u, b.u) AS c FROM n a, n b WHERE a.rowid <> b.rowid),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS k FROM s WHERE c >= 0.7)
SELECT DISTINCT least(a, b) AS rowid_a, greatest(a, b) AS rowid_b FROM r WHERE k <= 5 AND c >= 0.75""",
    "p4_found": f"""
WITH RECURSIVE {_USABLE},
n AS (SELECT rowid, list_transform(v, lambda e: e / sqrt(list_sum(list_transform(v, lambda f: f * f)))) AS u FROM usable),
s AS (SELECT a.rowid AS a, b.rowid AS b FROM n a, n b WHERE list_inner_product(a.u, b.u) >= 0.7 OR a.rowid = b.rowid),
m AS (SELECT a, min(b) AS b FROM s GROUP BY a),
walk AS (SELECT a AS node, a AS root FROM n JOIN m ON a = rowid WHERE a = b
  UNION SELECT s.b, walk.root FROM walk JOIN s ON s.a = walk.node),
g AS (SELECT node AS rowid, min(root) AS cluster_key FROM walk GROUP BY node)
SELECT rowid, cluster_key FROM g WHERE cluster_key IN (SELECT cluster_key FROM g GROUP BY 1 HAVING count(*) >= 3)""",
    "p7_found": f"WITH {_similar_sql(3, '0.5')} SELECT id_a, id_b FROM alike",
    "p7_groups": f"""WITH RECURSIVE {_similar_sql(5, '0.8')},
u AS (SELECT id_a AS a, id_b AS b FROM alike UNION SELECT id_b, id_a FROM alike),
walk AS (SELECT a AS id, least(a, min(b)) AS root FROM u GROUP BY a UNION SELECT u.b, walk.root FROM walk JOIN u ON u.a = walk.id WHERE walk.root < u.b)
SELECT id, min(root) AS group_id, (SELECT count(*) FROM u WHERE a = id) AS n_links FROM walk GROUP BY id""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM d WHERE len(ws) >= 12),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM i WHERE len(ws) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
