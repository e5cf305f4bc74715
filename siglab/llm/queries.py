"""One query for each operator, over the whole table it is meant for, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglab.llm import alignment, conversation_trie, dart_dedup, fingerprint, html_blocks, line_runs, mixing, packing, quality, secrets, sharding, topk, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return fingerprint.against_next(docs, fingerprint.classes(docs))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "source", "lang", "n_chars", "text", "repeats_", "copy_", "mixed_at_")


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_documents(spark, sf_dir))


def op6_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    scored = quality.score(_documents(spark, sf_dir), labels.filter(~held))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_dart_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_dedup.near_classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "kept")


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir), F.col("source"), F.concat_ws("/", "source", "lang"))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_frequent(_documents(spark, sf_dir))
    return kept.select("doc_id", F.col("line_runs_n_lines").alias("n_lines"), F.col("line_runs_n_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_taat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_documents(spark, sf_dir), *map(tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.of_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_fingerprints, op2_best_fit_packing, op3_toxicity_chain, op4_poisson_mixing, op5_feistel_shards, op6_rff_quality, op7_dart_near_dedup, op8_secret_ownership, op9_line_runs, op10_taat_topk, op11_token_alignment, op12_prefix_trie, op13_html_main_text)
    return {f.__name__: f for f in listed}


OP4_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
share AS (SELECT source, n, sqrt(n::double) / (SELECT sum(sqrt(n::double)) FROM n) AS w, (SELECT sum(n) FROM n) AS total FROM n),
mean AS (SELECT source, w * total / n AS m FROM share),
law AS (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c
        FROM (SELECT source, k, exp(CASE WHEN k > 0 THEN k * ln(m) ELSE 0 END - m - lgamma(k + 1.0)) AS term
              FROM (SELECT source, m, unnest(range(0, (m + 12 * sqrt(m) + 40)::bigint)) AS k FROM mean))),
d AS (SELECT doc_id, source, lang, n_chars, text,
             md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::varchar, '~'), coalesce(source, '~'), coalesce(md5(text), '~'))) AS content FROM documents),
u AS (SELECT *, ('0x' || substr(content, 1, 13))::bigint::double / 4503599627370496.0 AS u FROM d),
drawn AS (SELECT u.*, (SELECT count(*) FROM law WHERE law.source IS NOT DISTINCT FROM u.source AND law.c <= u.u) AS repeats_ FROM u)
SELECT doc_id, source, lang, n_chars, text, repeats_::integer AS repeats_, copy_::integer AS copy_,
       md5(concat_ws('|', content, copy_::varchar)) AS mixed_at_
FROM drawn, LATERAL (SELECT unnest(range(0, repeats_)) AS copy_)
"""


def _matches(kind: int, pattern: str, group: int, keep: str = "true") -> str:
    """Spans of one kind: the lengths of what is between matches and of matches, added up."""
    p = pattern.replace("'", "''")
    return f"""SELECT r, owner, repo, {kind} AS kind, start, start + length(whole) AS stop, val FROM (
 SELECT *, sum(length(gap)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(whole)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
  SELECT r, owner, repo, unnest(w) AS whole, unnest(v) AS val, unnest(g[1:len(w)]) AS gap, unnest(range(len(w))) AS i
  FROM (SELECT r, owner, repo, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d) WHERE len(w) > 0)) WHERE {keep}"""


_NAME = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END"
_SPAN = f"string_agg({_NAME} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '~') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
m AS ({_matches(0, secrets.ASSIGN, 2, f"length(val) >= {secrets.LEAST_ASSIGNED}")} UNION ALL {_matches(1, secrets.ACCESS, 0)} UNION ALL {_matches(2, secrets.HEX, 0)} UNION ALL {_matches(3, secrets.VENDOR, 0)}),
held AS (SELECT sha256(val) AS s, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM m GROUP BY ALL),
j AS (SELECT m.*, owners, repos, owners < {secrets.OWNERS} AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 6
 AND NOT regexp_matches(val, '{secrets.STANDINS}') AS live FROM m JOIN held ON sha256(m.val) = held.s),
x AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, {_SPAN} FILTER (WHERE kind < 3) AS base,
 {_SPAN} FILTER (WHERE kind < 3 OR live) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE owners >= {secrets.OWNERS}) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repositories, {_SPAN} FILTER (WHERE live) AS live_spans FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
 coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories, coalesce(live_spans, '') AS live_spans FROM d LEFT JOIN x USING (r)
"""

_KEY = r"translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT r, i, line, {_KEY} AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= {line_runs.DOCUMENTS}),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM hot)) AS text, count(*) FILTER (WHERE key IN (SELECT key FROM hot)) AS n_dropped, count(*) AS n_lines FROM k GROUP BY r)
SELECT doc_id, n_lines::bigint AS n_lines, n_dropped::bigint AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d JOIN kept USING (r)
"""

OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::integer AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# CRC-32 from its definition: a table of 256 remainders by eight shifts each, then one step a byte.
_CRC = "xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, x: xor(c // 256, crc[(xor(c, x) % 256 + 1)::integer]), 4294967295::bigint), 4294967295::bigint)"
OP12_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, n::bigint)) AS crc),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {conversation_trie.FAMILY} AS base, n, {_CRC} % {conversation_trie.LENGTHS} AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc),
r AS (SELECT c.conv_id, i + 1 AS depth, role, text FROM c JOIN t ON t.conv_id = c.base WHERE i < c.h
 UNION ALL SELECT c.conv_id, i - c.h + least(c.h, coalesce(b.n, 0)) + 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE i >= c.h),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, sha256(to_json(list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth))::varchar) AS node FROM r
 UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
node AS (SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saves FROM p GROUP BY node),
link AS (SELECT DISTINCT below.node, top.node AS parent FROM p below JOIN p top ON below.conv_id = top.conv_id AND below.depth = top.depth + 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM link GROUP BY parent),
under AS (SELECT DISTINCT top.node AS node, below.node AS below FROM p top JOIN p below ON top.conv_id = below.conv_id AND top.depth <= below.depth),
sums AS (SELECT under.node, sum(saves) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves FROM under JOIN node ON node.node = under.below LEFT JOIN kids ON kids.node = under.below GROUP BY under.node),
ends AS (SELECT node, string_agg(conv_id::varchar, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(node, depth) AS node FROM p GROUP BY conv_id) GROUP BY node)
SELECT node.conv_id, node.depth::bigint AS depth, top.conv_id AS parent_conv_id, node.n_convs::bigint AS n_convs, coalesce(n_children, 0)::bigint AS n_children, n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN link USING (node) LEFT JOIN node top ON top.node = link.parent LEFT JOIN kids ON kids.node = node.node JOIN sums ON sums.node = node.node LEFT JOIN ends ON ends.node = node.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_poisson_mixing": OP4_SQL, "op8_secret_ownership": OP8_SQL, "op9_line_runs": OP9_SQL, "op10_taat_topk": OP10_SQL, "op12_prefix_trie": OP12_SQL}
