"""Operational queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.operators import operations as ops
from docuflux.registry import register

from .text import read

MESSAGES = "m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ai' ELSE role END AS role, text FROM conversations WHERE role IN ('user', 'assistant'))"


@register("w18_history", f"WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM m) SELECT conv_id, count(*) AS n_messages, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'AI: ' END || text, chr(10) ORDER BY turn) FILTER (r <= 6) AS history FROM r GROUP BY 1")
def w18(spark, sf_dir):
    return ops.history(read(spark, sf_dir, "conversations"))


@register("f14_summary_language", f"WITH {MESSAGES} SELECT conv_id, CASE WHEN bool_or(role = 'user' AND regexp_matches(text, '[؀-ۿ]')) THEN 'Arabic' ELSE 'English' END AS language, count(*) >= 4 AS summarise FROM m GROUP BY 1")
def f14(spark, sf_dir):
    return ops.summary_language(read(spark, sf_dir, "conversations"))


@register("x5_rate_windows", "SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS calls, greatest(0, 2 - count(*)) AS remaining, greatest(0, count(*) - 2) AS rejected FROM events GROUP BY ALL")
def x5(spark, sf_dir):
    return ops.rate_windows(read(spark, sf_dir, "events"), "user_id", width="1 hour", limit=2)


@register("x6_sessions", "WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '24 hours', true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS start, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s")
def x6(spark, sf_dir):
    return ops.sessions(read(spark, sf_dir, "events"), "user_id")


@register("x7_breaker")
def x7(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select("user_id", "ts", (F.col("value") < 30).alias("failed"))
    return ops.breaker(calls, "user_id")


@register("k11_golden", "SELECT text AS question, '' AS ground_truth FROM conversations WHERE role = 'user' AND turn % 3 = 1")
def k11(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    rows = turns.select(F.when(F.col("turn") % 3 == 1, "down").otherwise("up").alias("rating"), F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))
    return ops.golden(rows)


@register("u7_batches", "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch FROM documents")
def u7(spark, sf_dir):
    return ops.batched(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@register("u6_ranges", "WITH r AS (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS run FROM documents) SELECT lang, min(doc_id) AS first, max(doc_id) AS last FROM r GROUP BY lang, run")
def u6(spark, sf_dir):
    return ops.ranges(read(spark, sf_dir, "documents"), "lang", "doc_id")


@register("b16_rollup", "SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def b16(spark, sf_dir):
    return read(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@register("b13_timings", "SELECT event_type AS step, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def b13(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"))
