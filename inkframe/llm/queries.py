"""The dealt operators and the corpus pipeline bound to the test tables, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkframe.llm import alignment, fingerprints, hard_negatives, kd_shards, language_ratio, licenses, mixing, near_dups, packing, pii, quality, repeats, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


CRC_TABLE = (
    "(SELECT list(c ORDER BY i) AS l FROM (WITH RECURSIVE tb(k, i, c) AS (SELECT 0, i, i FROM range(256) r(i) UNION ALL "
    "SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM tb WHERE k < 8) SELECT i, c FROM tb WHERE k = 8))"
)


def _kd_sql(shards: int = 40) -> str:
    code = lambda c: f"coalesce(('0x' || rpad(substr(hex({c}), 1, 14), 14, '0'))::BIGINT, -1)"
    parts = [
        "r0 AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS t, "
        f"{code('source')} AS d1, {code('lang')} AS d2, coalesce(doc_id, -1) AS d3, 0 AS nd, {shards} AS m FROM documents)",
        "whole AS (SELECT " + ", ".join(f"greatest(1, max({d}) - min({d})) AS g{k}" for k, d in enumerate(("size", "d1", "d2", "d3"))) + " FROM r0)",
    ]
    parts += [
        f"tab AS {CRC_TABLE}",
        "hx AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents)",
        "sums AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), "
        "lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM hx, tab)",
    ]
    levels = (shards - 1).bit_length()
    for k in range(levels):
        wide = [f"(max({d}) OVER n - min({d}) OVER n)::DOUBLE / g{j}" for j, d in enumerate(("size", "d1", "d2", "d3"))]
        parts += [
            f"a{k} AS (SELECT r{k}.*, {', '.join(f'{w} AS w{j}' for j, w in enumerate(wide))}, sum(size) OVER n AS w FROM r{k}, whole WINDOW n AS (PARTITION BY nd))",
            f"b{k} AS (SELECT *, CASE WHEN w0 >= greatest(w1, w2, w3) THEN size WHEN w1 >= greatest(w2, w3) THEN d1 WHEN w2 >= w3 THEN d2 ELSE d3 END AS k FROM a{k})",
            f"c{k} AS (SELECT *, 2 * sum(size) OVER (PARTITION BY nd ORDER BY k, d3 ROWS UNBOUNDED PRECEDING) - size AS middle FROM b{k})",
            f"r{k + 1} AS (SELECT doc_id, size, t, d1, d2, d3, CASE WHEN m > 1 AND middle * m > 2 * w * (m // 2) THEN nd + m // 2 ELSE nd END AS nd, "
            f"CASE WHEN m = 1 THEN 1 WHEN middle * m > 2 * w * (m // 2) THEN m - m // 2 ELSE m // 2 END AS m FROM c{k})",
        ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, nd::INTEGER AS shard, "
        f"row_number() OVER (PARTITION BY nd ORDER BY d3) - 1 AS slot, NULL::INTEGER AS grown_shard FROM r{levels} JOIN sums USING (doc_id)"
    )


@query("op4_kd_shards", _kd_sql())
def op4_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards.shard_documents(documents(spark, folder), 40)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, source_size * 2 / w AS fills FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER b, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0)) AS level
      FROM f WINDOW b AS (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((source_size * 2)::DOUBLE, w * max(level) OVER ()) AS target FROM l),
o AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS goal,
      sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':7')) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - start)) END::BIGINT AS taken FROM o
"""


@query("op8_mix_sources", MIX_SQL)
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(documents(spark, folder))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_sum_of_squares_packing")
def op7_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), tokenizer_path())


@query("op10_importance_resampling")
def op10_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return quality.Classifier(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")).report()


@query("op1_consistent_sampling_dedup")
def op1_consistent_sampling_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, folder))


@query("op2_weak_supervision_pii")
def op2_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(documents(spark, folder))


@query("op6_one_permutation_minhash")
def op6_one_permutation_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.report(documents(spark, folder))


@query("op5_patience_licenses")
def op5_patience_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


@query("op9_maximal_repeats")
def op9_maximal_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, folder))


@query("op3_block_max_wand")
def op3_block_max_wand(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return search.more_like(docs, docs.where("doc_id % 20 = 0"))


RATIO_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
wd AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, a, b, c, e) AS n FROM (
  SELECT r, i, x, lead(x) OVER o AS a, lead(x, 2) OVER o AS b, lead(x, 3) OVER o AS c, lead(x, 4) OVER o AS e FROM wd WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE e IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM win, range(5) g(j) WHERE n > 1 GROUP BY r),
b AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN ln USING (r) LEFT JOIN rep USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
tab AS {CRC_TABLE},
strings AS (SELECT x FROM wd UNION SELECT substr(x, 1, 4) FROM wd),
crc AS (SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(x)) // 2),
  lambda i: ('0x' || substr(hex(x), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1]))) AS c FROM strings, tab),
grams AS (SELECT r, 0 AS kind, c, c & 1048575 AS cell FROM wd JOIN crc USING (x) UNION ALL SELECT r, 1, c, (c * 7) & 1048575 FROM wd JOIN crc ON crc.x = substr(wd.x, 1, 4)),
one AS (SELECT doc_id, min((quality = 1 AND coalesce(toxic, 0) = 0)::INT) AS clean FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT doc_id, clean, substr(md5(doc_id::VARCHAR), 32, 1) < '8' AS fit FROM one ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 40000),
n AS (SELECT cell, count(*) AS raw, count(lab.doc_id) AS trusted FROM (SELECT DISTINCT * FROM grams) JOIN d USING (r)
  LEFT JOIN lab ON d.doc_id = lab.doc_id AND fit AND clean = 1 GROUP BY cell),
shares AS (SELECT cell, trusted + 1.0::DOUBLE AS had, raw * ((sum(trusted) OVER ())::DOUBLE / sum(raw) OVER ()) + 1.0::DOUBLE AS expected FROM n),
ratios AS (SELECT cell, round(sign(ln(had / expected)) * greatest(0, abs(ln(had / expected)) - 0.5::DOUBLE - 3.0::DOUBLE * sqrt(1 / had + 1 / expected)) * 1000000)::BIGINT AS weight FROM shares),
s AS (SELECT r, sum(weight)::BIGINT::DOUBLE / count(*) / 1000000 AS log_ratio FROM grams JOIN ratios USING (cell) GROUP BY r),
scored AS (SELECT base.*, coalesce(log_ratio, 0.0::DOUBLE) AS log_ratio FROM base LEFT JOIN s USING (r)),
held AS (SELECT doc_id, clean, min(log_ratio) AS log_ratio FROM scored JOIN lab USING (doc_id) WHERE NOT fit AND NOT base_failed GROUP BY ALL),
per AS (SELECT log_ratio, sum(clean) AS good, sum(1 - clean) AS bad FROM held GROUP BY log_ratio),
gains AS (SELECT (coalesce(lag(log_ratio) OVER (ORDER BY log_ratio), log_ratio) + log_ratio) / 2 AS cut, sum(good) OVER () AS goods, sum(bad) OVER () AS bads,
  coalesce(sum(bad) OVER p, 0)::DOUBLE / sum(bad) OVER () - 4.0::DOUBLE * (coalesce(sum(good) OVER p, 0)::DOUBLE / sum(good) OVER ()) AS gain
  FROM per WINDOW p AS (ORDER BY log_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT cut FROM gains WHERE goods > 0 AND bads > 0 ORDER BY round(gain, 9) DESC, cut LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio,
  NOT base_failed AND log_ratio >= coalesce((SELECT cut FROM best), -1e300) AS kept FROM scored
"""


@query("op12_likelihood_ratio_rules", RATIO_SQL)
def op12_likelihood_ratio_rules(spark: SparkSession, folder: str) -> DataFrame:
    return language_ratio.report(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


@query("op13_cover_tree_negatives", NEGATIVES_SQL)
def op13_cover_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op11_fragment_alignment")
def op11_fragment_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
