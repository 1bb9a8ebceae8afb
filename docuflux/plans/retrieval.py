"""Retrieval queries: benchmark items ask, documents or vectors answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.functions import text as t
from docuflux.operators import retrieval as r
from docuflux.operators import vectors as vx
from docuflux.operators.hierarchy import pool_size
from docuflux.registry import register

from .text import read

BM25_SQL = r"""w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
  z AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
  tf AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM w) GROUP BY ALL),
  i0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, z GROUP BY term, n),
  i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
  q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
  b AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / avgdl))) AS score FROM tf JOIN i USING (term) JOIN q USING (term), z GROUP BY ALL),
  br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM b)"""
COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
DENSE_SQL = f"""dq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
  d AS (SELECT query_id, vec_id AS id, {COS.format(a="embedding", b="v")} AS score FROM embeddings, dq),
  dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM d)"""


def asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir):
    """All vectors, and as queries those whose id is divisible by 50."""
    all_ = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return all_, all_.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


@register("a2_bm25", f"WITH {BM25_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM br WHERE rank <= 10")
def a2(spark, sf_dir):
    return r.top(r.best_bm25(read(spark, sf_dir, "documents"), asked(spark, sf_dir), 10), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("t1_dense", f"WITH {DENSE_SQL} SELECT query_id, id, round(score, 5) AS score, rank FROM dr WHERE rank <= 10")
def t1(spark, sf_dir):
    all_, q = vectors(spark, sf_dir)
    return r.top(r.nearest(all_, q, 10), 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@register("j8_vector_index")
def j8_index(spark, sf_dir):
    """The ten nearest of each asking vector by the index; its recall is held against all rows in the tests."""
    all_, q = vectors(spark, sf_dir)
    centres = vx.fit(all_)
    return vx.search(vx.indexed(all_, centres), q, centres, 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@register("a1_rrf", f"""WITH {DENSE_SQL}, n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY abs(id - query_id), id) AS rank FROM d),
  u AS (SELECT query_id, id, rank, 0 AS l FROM dr WHERE rank <= 20 UNION ALL SELECT query_id, id, rank, 1 FROM n WHERE rank <= 20),
  f AS (SELECT query_id, id, sum(1 / (60 + rank)) AS s, min((l, rank)) AS seen FROM u GROUP BY ALL)
  SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, seen) AS rank FROM f""")
def a1(spark, sf_dir):
    """Fuses each query's nearest vectors with its nearest ids."""
    all_, q = vectors(spark, sf_dir)
    return r.fused(r.top(r.nearest(all_, q, 20), 20), r.beside(all_, q, 20)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("r1_gate", f"WITH {BM25_SQL}, g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM br WHERE rank <= 3) SELECT query_id, id, rank, round(best, 6) AS best_score FROM g WHERE best >= 60")
def r1(spark, sf_dir):
    kept = r.gated(r.top(r.best_bm25(read(spark, sf_dir, "documents"), asked(spark, sf_dir), 3), 3), 60.0)
    return kept.select("query_id", "id", "rank", F.round("best_score", 6).alias("best_score"))


@register("r2_mmr")
def r2(spark, sf_dir):
    all_, q = vectors(spark, sf_dir)
    got = r.top(r.nearest(all_, q, pool_size(3)), pool_size(3)).join(all_.select("id", "embedding"), "id")
    return r.mmr(got.select("query_id", "id", "score", "rank", "embedding"), 3)


#: A question's vector is the sum of those that its words name, each by its digest, as no encoder is at hand.
QUESTION_SQL = f"""w0 AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
  wv AS (SELECT item_id AS query_id, i, cast('0x' || substr(md5(w[i + 1]), 1, 7) AS bigint) % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT item_id, w, unnest(range(len(w))) AS i FROM w0)),
  qe AS (SELECT query_id, list(s ORDER BY p) AS v FROM (SELECT query_id, p, sum(x) AS s FROM (SELECT query_id, unnest(range(len(embedding))) AS p, unnest(embedding::DOUBLE[]) AS x FROM wv JOIN embeddings USING (vec_id)) GROUP BY ALL) GROUP BY 1),
  qd AS (SELECT query_id, vec_id AS id, {COS.format(a="embedding", b="v")} AS score FROM embeddings, qe),
  qr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM qd)"""
HYBRID_SQL = f"""WITH {BM25_SQL}, {QUESTION_SQL},
  u AS (SELECT query_id, id, rank, 0 AS l FROM qr WHERE rank <= {{k}} UNION ALL SELECT query_id, id, rank, 1 FROM br WHERE rank <= {{k}}),
  f AS (SELECT query_id, id, sum(1 / (60 + rank)) AS s, min((l, rank)) AS seen FROM u GROUP BY ALL),
  x AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, seen) AS rank FROM f)
  SELECT {{columns}} FROM {{rows}}"""


def questions(spark, sf_dir):
    """(query_id, vector): the sum of the vectors that a question's words stand for."""
    vecs = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    n = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    words = asked(spark, sf_dir).select("query_id", F.explode(t.bm25_tokens(F.col("text"))).alias("w")).crossJoin(F.broadcast(n))
    own = words.select("query_id", (F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("long") % F.col("n")).alias("vec_id"))
    sums = own.join(vecs, "vec_id").groupBy("query_id", "p").agg(F.sum("x").alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("p", "x")))
    return sums.groupBy("query_id").agg(F.transform(parts, lambda e: e["x"]).alias("vector"))


def hybrid(spark, sf_dir, k):
    """The k best of each question by its vector, and by BM25, fused."""
    all_, _ = vectors(spark, sf_dir)
    near = r.top(r.nearest(all_, questions(spark, sf_dir), k), k).select("query_id", "id", "rank")
    return r.fused(near, r.top(r.best_bm25(read(spark, sf_dir, "documents"), asked(spark, sf_dir), k), k))


@register("r3_hybrid", HYBRID_SQL.format(k=10, columns="x.query_id, x.id, x.rank, round(s, 6) AS score, d.text", rows="x LEFT JOIN documents d ON d.doc_id = x.id WHERE rank <= 3"))
def r3(spark, sf_dir):
    """Dense and BM25 lists fused, with the whole texts."""
    out = hybrid(spark, sf_dir, 10).filter("rank <= 3")
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return out.join(texts, "id", "left").select("query_id", "id", "rank", F.round("score", 6).alias("score"), "text")


@register("t6_boost", f"WITH {DENSE_SQL}, k AS (SELECT dr.query_id, dr.id, dr.rank, e.label % 2 = 0 AS flag FROM dr JOIN embeddings e ON e.vec_id = dr.id WHERE dr.rank <= 10) SELECT query_id, id, flag, row_number() OVER (PARTITION BY query_id ORDER BY flag::int DESC, rank) AS rank FROM k")
def t6(spark, sf_dir):
    all_, q = vectors(spark, sf_dir)
    got = r.top(r.nearest(all_, q, 10), 10).join(all_.select("id", (F.col("label") % 2 == 0).alias("flag")), "id")
    return r.boosted(got, "flag").select("query_id", "id", "flag", "rank")


@register("u3_citations", "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def u3(spark, sf_dir):
    return r.first_of(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.desc("n_chars"), "doc_id"]).drop("n_chars")


@register("t9_page", "SELECT doc_id, source, CASE WHEN (SELECT count(*) FROM documents) > 150 THEN 150 END AS next_cursor FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def t9(spark, sf_dir):
    return r.page(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100, 50)
