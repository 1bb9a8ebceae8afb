"""Incremental ingest: documents are version 1; in version 2 every third one is altered and every
seventh new lines of text arrive, and lines are the chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.functions import text as t
from docuflux.operators import index, ingest
from docuflux.operators import versions as vs
from docuflux.registry import register
from docuflux.session import shared_folder

from .retrieval import BM25_SQL, asked
from .text import STRIP, read

ALTERED = "CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '^[^\\n]*', 'Changed line of ' || doc_id) ELSE text END"
CHUNKS_SQL = rf"""o AS (SELECT doc_id, md5({STRIP('c')}) AS chunk_hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents) WHERE {STRIP('c')} <> ''),
  n AS (SELECT doc_id, md5({STRIP('c')}) AS chunk_hash FROM (SELECT doc_id, unnest(string_split({ALTERED}, chr(10))) AS c FROM documents) WHERE {STRIP('c')} <> '')"""


def chunks(docs):
    parts = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("c")).select("doc_id", t.strip(F.col("c")).alias("c"))
    return parts.filter("c <> ''").select("doc_id", F.md5("c").alias("chunk_hash"))


def versions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    changed = F.regexp_replace(F.col("text"), F.lit(r"^[^\n]*"), F.concat(F.lit("Changed line of "), F.col("doc_id")))
    return chunks(docs), chunks(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, changed).otherwise(F.col("text"))))


@register("j1_stale", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_hash FROM o WHERE (doc_id, chunk_hash) NOT IN (SELECT doc_id, chunk_hash FROM n) AND doc_id IN (SELECT doc_id FROM n)")
def j1(spark, sf_dir):
    return ingest.stale(*versions(spark, sf_dir)).select("doc_id", "chunk_hash")


@register("j2_fresh", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_hash FROM n WHERE (doc_id, chunk_hash) NOT IN (SELECT doc_id, chunk_hash FROM o)")
def j2(spark, sf_dir):
    return ingest.fresh(*versions(spark, sf_dir)).select("doc_id", "chunk_hash")


@register(
    "a5_ingest_counts",
    f"""WITH {CHUNKS_SQL}, t AS (SELECT doc_id, count(*) AS total FROM n GROUP BY 1),
    a AS (SELECT doc_id, count(*) AS added FROM n WHERE (doc_id, chunk_hash) NOT IN (SELECT doc_id, chunk_hash FROM o) GROUP BY 1),
    r AS (SELECT doc_id, count(*) AS removed FROM o WHERE (doc_id, chunk_hash) NOT IN (SELECT doc_id, chunk_hash FROM n) GROUP BY 1)
    SELECT doc_id, total, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM t LEFT JOIN a USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def a5(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    total = new.groupBy("doc_id").agg(F.count("*").alias("total"))
    added = ingest.fresh(old, new).groupBy("doc_id").agg(F.count("*").alias("added"))
    removed = ingest.stale(old, new).groupBy("doc_id").agg(F.count("*").alias("removed"))
    out = total.join(added, "doc_id", "left").join(removed, "doc_id", "left")
    return out.select("doc_id", "total", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


@register("k2_store", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_hash, count(*) AS n FROM (SELECT * FROM o WHERE (doc_id, chunk_hash) IN (SELECT doc_id, chunk_hash FROM n) UNION ALL SELECT * FROM n WHERE (doc_id, chunk_hash) NOT IN (SELECT doc_id, chunk_hash FROM o)) GROUP BY ALL")
def k2(spark, sf_dir):
    return ingest.applied(*versions(spark, sf_dir)).groupBy("doc_id", "chunk_hash").agg(F.count("*").alias("n"))


@register(
    "u5_statuses",
    """WITH k AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), f AS (SELECT doc_id, md5(text) AS h FROM documents),
    s AS (SELECT f.doc_id, k.h = f.h AS same, (SELECT min(x.doc_id) FROM k x WHERE x.h = f.h AND x.doc_id <> f.doc_id) AS other FROM f LEFT JOIN k USING (doc_id))
    SELECT doc_id, CASE WHEN same THEN 'unchanged' WHEN other IS NOT NULL THEN 'duplicate' ELSE 'ingest' END AS status,
      CASE WHEN same THEN NULL ELSE other END AS duplicate_of FROM s""",
)
def u5(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("file_hash"))
    return ingest.statuses(files.filter("doc_id % 2 = 0"), files)


@register("k3_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def k3(spark, sf_dir):
    """The latest state of each user, from two halves of the events."""
    ev = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("version"))
    return ingest.upserted(ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1"), ["user_id"], "version").drop("version")


def texts(spark, sf_dir):
    """All documents before and after the change."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    changed = F.regexp_replace(F.col("text"), F.lit(r"^[^\n]*"), F.concat(F.lit("Changed line of "), F.col("doc_id")))
    return docs, docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, changed).otherwise(F.col("text")))


@register("a2_index_search", f"WITH {BM25_SQL.replace('FROM documents)', f'FROM (SELECT doc_id, {ALTERED} AS text FROM documents WHERE doc_id % 7 <> 3))')} SELECT query_id, id, round(score, 6) AS score, rank FROM br WHERE rank <= 10")
def a2_index(spark, sf_dir):
    """An index of all documents; then every third one changes and every seventh goes."""
    old, new = texts(spark, sf_dir)
    store = vs.Versions(spark, shared_folder(spark, "index"), 16)
    index.update(store, old.select(F.col("doc_id").alias("id"), "text"))
    changed = new.filter("doc_id % 3 = 0 and doc_id % 7 <> 3").select(F.col("doc_id").alias("id"), "text")
    index.update(store, changed, new.filter("doc_id % 7 = 3").select(F.col("doc_id").alias("id")))
    return index.search(store, asked(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def stored(docs, status):
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "c")).select("doc_id", "place", t.strip(F.col("c")).alias("text")).filter("text <> ''")
    return lines.select("doc_id", "place", F.md5("text").alias("chunk_hash"), "text"), docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"), F.lit(status).alias("status"))


@register("k3_chunk_sets", rf"""WITH v AS (SELECT doc_id, text AS was, {ALTERED} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM v), c AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT md5({STRIP('c')}), ',' ORDER BY md5({STRIP('c')})) AS hashes FROM l WHERE {STRIP('c')} <> '' GROUP BY 1)
  SELECT doc_id, md5(coalesce(text, '')) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'replaced' ELSE 'ingested' END AS status, coalesce(n, 0)::INT AS n_chunks, md5(coalesce(hashes, '')) AS chunk_hashes FROM v LEFT JOIN c USING (doc_id)""")
def k3_sets(spark, sf_dir):
    """All documents are stored; then those that changed take the place of their old chunk sets."""
    old, new = texts(spark, sf_dir)
    store = vs.Versions(spark, shared_folder(spark, "chunks"), 16)
    vs.replace_documents(store, *stored(old, "ingested"))
    vs.replace_documents(store, *stored(new.filter("doc_id % 3 = 0"), "replaced"))
    sets = store.read("chunks", vs.CHUNKS).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("chunk_hash")), ",").alias("hashes"))
    return store.read("states", vs.STATES).join(sets, "doc_id", "left").select("doc_id", "content_hash", "status", "n_chunks", F.md5(F.coalesce("hashes", F.lit(""))).alias("chunk_hashes"))
