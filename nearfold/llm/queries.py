"""The registered queries of this subpackage: opN_<name>, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import decontaminate, fingerprints, htmlpages, licenses, lm_score, minhash, pieces, pivots, quality, repeats, spellings, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlpages.extract_pages(_read(spark, sf_dir, "pages"))


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), digest=True)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_read(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(_read(spark, sf_dir, "documents"))


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variant_query(_read(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.run_query(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ten = (op1_lm_scores, op2_html, op3_pivots, op4_toxicity, op5_licenses, op6_quality, op7_token_counts, op8_decontaminate, op9_minhash, op10_pieces)
    return {f.__name__: f for f in (*ten, op11_fingerprints, op12_spellings, op13_runs)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
#: Smallest node that each node of `nodes` reaches over the edges of `e`, both of whose directions are there.
_REACH = "reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r), least_ AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"

_LINKS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), nodes AS (SELECT id FROM v),
u AS (SELECT id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
e AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id <> q.id WHERE list_inner_product(p.x, q.x) >= 0.9 * p.n * q.n), {_REACH}
SELECT l.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = l.id) AS n_links, component_id, component_id = l.id AS kept FROM least_ l"""

_LEAKS = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
pattern AS (SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(w[k:k + 12], ' ') AS p FROM b, range(1, 100000) t(k) WHERE len(w) > 0 AND k <= greatest(1, len(w) - 12)),
place AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM pattern))),
hit AS (SELECT doc_id, k, place.m AS m, item FROM place JOIN pattern ON place.m = pattern.m AND place.p = pattern.p),
cover AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS spot FROM hit) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(told.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN told USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_BLANK} AS w FROM documents), nodes AS (SELECT id FROM d),
sets AS (SELECT id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT id, len(s) AS n, unnest(s) AS t FROM sets),
e AS (SELECT p.id AS a, q.id AS b FROM x p JOIN x q ON p.t = q.t AND p.id <> q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))), {_REACH}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = id AS kept FROM least_ JOIN sets USING (id)"""


_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc"
_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END))"
_VARIANTS = rf"""WITH RECURSIVE t AS MATERIALIZED ({_CRC_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM d, t),
cut AS (SELECT n, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gap AS MATERIALIZED (SELECT word, k, word[:k - 1] AS l, word[k + 1:] AS r FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM v)),
near AS MATERIALIZED (SELECT a.word, b.word AS other FROM gap a JOIN gap b ON a.k = b.k AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word FROM gap a JOIN v b ON b.word = a.l || a.r UNION SELECT b.word, a.word FROM gap a JOIN v b ON b.word = a.l || a.r),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-m.n, other)) AS form, max(m.n) AS form_n FROM near JOIN v m ON m.word = other GROUP BY near.word),
told AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS up FROM told UNION ALL SELECT walk.word, told.word, told.form FROM walk JOIN told ON told.word = walk.up)
SELECT told.word, form, walk.at AS root, n, n_near, form_n FROM told JOIN walk ON walk.word = told.word AND walk.up IS NULL"""


def oracle_sql() -> dict[str, str]:
    """For the exact operators.  The others train a model or follow a tokenizer, which SQL cannot express; tests hold
    them against brute force, the libraries, or labels kept apart."""
    return {"op3_pivots": _LINKS, "op8_decontaminate": _LEAKS, "op9_minhash": _NEAR, "op12_spellings": _VARIANTS}
