"""One query per operator, over the whole given tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digests, format_chats
from .common import held_out
from .decontaminate import decontaminate
from .filter_audit import filter_audit
from .hard_negatives import hard_negatives
from .language import identify
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .pii import KINDS, personal_data
from .registry import ORACLES, QUERIES, query, table
from .secrets import secrets
from .sharding import shard
from .suffix_dedup import suffix_dedup
from .topk import top_k
from .toxicity import toxicity

__all__ = ["ORACLES", "QUERIES"]


OP1_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
    FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY u, v),
l AS (SELECT u, v FROM p JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


@query("op1_ngram_jaccard", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * x)::BIGINT FOR x IN min(embedding::DOUBLE[])] AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    GROUP BY vec_id),
s AS (
    SELECT q.vec_id AS query_id, d.vec_id,
           list_sum([q.w[i] * d.w[i] FOR i IN range(1, len(q.w) + 1)])::BIGINT AS score
    FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5
"""


@query("op2_topk_search", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), keep=("doc_id",))
    base = F.filter("pii", lambda s: s["pattern"])

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


@query("op6_histogram_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    placed = shard(docs.select("doc_id", "text"), shards=8)
    return placed.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
           row_number() OVER (ORDER BY source NULLS LAST) AS r
    FROM d GROUP BY source),
c AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS left_words,
           sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_weight
    FROM s WINDOW o AS (ORDER BY 3 * source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT s.*, CASE WHEN 3 * c.source_size * c.left_weight <= c.w * c.left_words THEN CAST(3 * c.source_size AS DOUBLE)
                     ELSE CAST(c.w * (SELECT max(left_words) FROM c WHERE 3 * source_size * left_weight > w * left_words) AS DOUBLE)
                          / (SELECT max(left_weight) FROM c WHERE 3 * source_size * left_weight > w * left_words) END AS target
    FROM s JOIN c USING (r)),
p AS (
    SELECT d.*, t.r, t.source_size, t.target,
           sum(size) OVER (PARTITION BY t.r ORDER BY m, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
    SELECT p.*, k.k, CAST(k.k * source_size + upto AS DOUBLE) / target AS finish
    FROM p JOIN (SELECT unnest([0, 1, 2]) AS k) k ON size > 0 AND target > 0 AND k.k < ceil(target / source_size)),
z AS (SELECT *, sum(size) OVER (ORDER BY finish, r, upto, k ROWS UNBOUNDED PRECEDING) AS spent FROM q),
n AS (SELECT r, upto, count(*) AS copies FROM z WHERE spent <= (SELECT sum(size) FROM d) GROUP BY r, upto)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN coalesce(copies, 0) * size ELSE 0 END::BIGINT AS taken
FROM p LEFT JOIN n USING (r, upto)
"""


@query("op7_fair_mix", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select("doc_id", "contaminated", F.col("leaked_item").alias("item_id"), F.col("leaked_share").alias("share"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), path="source")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS g,
           [floor(256 * x)::BIGINT FOR x IN embedding::DOUBLE[]] AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.g = b.g AS same,
           list_sum([a.w[i] * b.w[i] FOR i IN range(1, len(a.w) + 1)])::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY rank <= 10
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
            100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
            regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > m.first, false)] AS fails
    FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
o AS (
    SELECT '' AS s
    UNION ALL
    SELECT s || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(s, c)),
q AS (SELECT s AS filter_order, k.step, ascii(s[k.step]) - 64 AS f FROM o, (SELECT unnest(range(1, 6)) AS step) k WHERE length(s) = 5),
x AS (
    SELECT part, filter_order, step, f, good, toxic, fails[f] AS own,
           len([1 FOR i IN range(1, step) IF fails[ascii(filter_order[i]) - 64]]) > 0 AS gone,
           fails[f] AND len([b FOR b IN fails IF b]) = 1 AS alone
    FROM f, q),
c AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
           count_if(NOT gone AND NOT own)::BIGINT AS kept, count_if(NOT gone AND own)::BIGINT AS removed,
           count_if(gone AND own)::BIGINT AS redundant, count_if(alone)::BIGINT AS unique_fails,
           count_if(NOT gone AND own AND good)::BIGINT AS good_lost, count_if(NOT gone AND own AND toxic)::BIGINT AS toxic_lost
    FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM c
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation about the template's own control strings.
TRAP = r"\### Assistant: </turn> ok"

OP13_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
    UNION ALL
    SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (SELECT unnest([0, 1]) AS k))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(13 + length(replace(replace(replace(replace(r, '\', '\\'), '#', '\#'), '</', '<\/'), chr(10), '\n'))
              + length(replace(replace(replace(x, '\', '\\'), '#', '\#'), '</', '<\/')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op13_chat_formatting", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(given.unionByName(trap)))
