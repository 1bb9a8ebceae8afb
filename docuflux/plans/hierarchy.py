"""Queries of sections, elements and retrieval over two levels; pages are documents of five elements a page."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.functions import text as t
from docuflux.operators import hierarchy as h
from docuflux.operators import operations as ops
from docuflux.operators import retrieval as r
from docuflux.operators import structure as st
from docuflux.registry import register

from .retrieval import DENSE_SQL, HYBRID_SQL, hybrid, vectors
from .structure import ELEMENTS
from .text import STRIP, TOKENS, read

E = f"""{ELEMENTS}, e5 AS (SELECT page_id AS doc_id, seq, (seq // 5 + 1)::INT AS page, CASE WHEN type = 'paragraph' AND seq % 7 = 3 THEN 'list' ELSE type END AS type, level, content FROM e),
  s AS (SELECT *, sum((type = 'heading')::INT) OVER w AS section, last_value(CASE WHEN type = 'heading' THEN content END IGNORE NULLS) OVER w AS section_title,
    last_value(CASE WHEN type = 'heading' THEN coalesce(level, 1) END IGNORE NULLS) OVER w AS section_level FROM e5 WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  stripped AS (SELECT *, {STRIP('content')} AS body FROM s),
  sections AS (SELECT doc_id, section, max(section_title) AS section_title, max(CASE WHEN type = 'heading' THEN level END) AS heading_level, arg_min(page, seq) AS page, arg_max(page, seq) AS page_end,
    coalesce(string_agg(CASE WHEN type = 'heading' THEN repeat('#', section_level) || ' ' || content WHEN length(body) > 0 THEN body END, chr(10) || chr(10) ORDER BY seq), '') AS text FROM stripped GROUP BY ALL)"""


def elements(spark, sf_dir):
    kind = F.when((F.col("type") == "paragraph") & (F.col("seq") % 7 == 3), "list").otherwise(F.col("type"))
    return st.elements(read(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), "seq", F.floor(F.col("seq") / 5 + 1).cast("int").alias("page"), kind.alias("type"), "level", "content")


@register("g5_sections", f"WITH {E} SELECT doc_id, section, section_title, heading_level, page, page_end, text FROM sections WHERE length(trim(text)) > 0")
def g5_sections(spark, sf_dir):
    return h.section_texts(elements(spark, sf_dir))


CLEAN = STRIP("regexp_replace(regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")


@register("g5_elements", f"""WITH {E}, c AS (SELECT *, {CLEAN.format('content')} AS page_content FROM s WHERE type <> 'heading')
  SELECT doc_id, seq, page, section, section_title, type AS element_type, page_content, md5(page_content) AS chunk_hash FROM c WHERE page_content <> ''""")
def g5_elements(spark, sf_dir):
    rows = h.two_levels(elements(spark, sf_dir)).filter("chunk_level = 2")
    return rows.select("doc_id", "seq", "page", "section", "section_title", "element_type", "page_content", "chunk_hash")


@register("g5_two_levels")
def g5(spark, sf_dir):
    return h.two_levels(elements(spark, sf_dir))


@register("u2_level_counts", f"""WITH {E}, c AS (SELECT doc_id, count(*) AS elements FROM s WHERE type <> 'heading' AND {CLEAN.format('content')} <> '' GROUP BY 1), p AS (SELECT doc_id, count(*) AS sections FROM sections WHERE length(trim(text)) > 0 GROUP BY 1)
  SELECT doc_id, coalesce(elements, 0) AS elements, sections FROM p LEFT JOIN c USING (doc_id)""")
def u2(spark, sf_dir):
    """Sections and elements of each document among its two levels of chunks, united."""
    out = h.two_levels(elements(spark, sf_dir)).groupBy("doc_id")
    return out.agg(F.count_if(F.col("chunk_level") == 2).alias("elements"), F.count_distinct(F.when(F.col("chunk_level") == 1, F.col("section"))).alias("sections"))


@register("g6_element_chunks", f"WITH {E} SELECT doc_id, seq, content AS text, type, page FROM e5")
def g6(spark, sf_dir):
    return h.element_chunks(elements(spark, sf_dir))


@register("g7_section_chunks", f"WITH {E} SELECT doc_id, section, max(section_title) AS heading, max(CASE WHEN type = 'heading' THEN page END) AS page, string_agg(content, chr(10) ORDER BY seq) AS text FROM s WHERE type = 'heading' OR length(content) > 0 GROUP BY ALL")
def g7(spark, sf_dir):
    return h.section_chunks(elements(spark, sf_dir))


@register("w3_sized_chunks", f"""WITH RECURSIVE {E}, o AS (SELECT doc_id, seq, page, content, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM e5),
  walk AS (SELECT doc_id, i, 0 AS chunk, length(content) + 1 AS held, page, content FROM o WHERE i = 1
    UNION ALL SELECT o.doc_id, o.i, CASE WHEN walk.held >= 200 THEN walk.chunk + 1 ELSE walk.chunk END, CASE WHEN walk.held >= 200 THEN 0 ELSE walk.held END + length(o.content) + 1, o.page, o.content FROM walk JOIN o ON o.doc_id = walk.doc_id AND o.i = walk.i + 1),
  c AS (SELECT doc_id, chunk, {STRIP("string_agg(content, chr(10) ORDER BY i)")} AS text, list_sort(list(DISTINCT page)) AS pages FROM walk GROUP BY ALL)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1)::INT AS chunk, text, pages FROM c WHERE text <> ''""")
def w3(spark, sf_dir):
    return h.sized_chunks(elements(spark, sf_dir))


#: A pool of ten candidates for each conversation's questions: elements of a page, sections first by rank.
POOL = f"""{E}, q AS (SELECT conv_id * 100 + turn AS query_id, CASE turn % 4 WHEN 0 THEN 'Compare ' WHEN 1 THEN '' WHEN 2 THEN 'What is ' ELSE 'growth of ' END || text AS question, conv_id FROM conversations WHERE role = 'user'),
  n AS (SELECT count(*) AS n FROM pages),
  el AS (SELECT doc_id, seq, section, 2 AS chunk_level, CASE WHEN seq % 3 = 0 THEN 'table' ELSE 'paragraph' END AS element_type, 'e' || doc_id || '-' || seq AS chunk_hash, 's' || doc_id || '-' || section AS parent_chunk_id FROM s WHERE type <> 'heading'),
  se AS (SELECT doc_id, 10000 + section AS seq, section, 1 AS chunk_level, 'section' AS element_type, 's' || doc_id || '-' || section AS chunk_hash, NULL AS parent_chunk_id FROM sections),
  cand AS (SELECT *, doc_id * 100000 + seq AS id, row_number() OVER (PARTITION BY doc_id ORDER BY md5(chunk_hash), chunk_hash) AS rank FROM (SELECT * FROM el UNION ALL SELECT * FROM se)),
  pool AS (SELECT query_id, question, cand.* FROM q, n JOIN cand ON cand.doc_id = q.conv_id % n.n WHERE rank <= 12)"""


def pool(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    n = read(spark, sf_dir, "pages").count()
    asked = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(F.expr("case turn % 4 when 0 then 'Compare ' when 1 then '' when 2 then 'What is ' else 'growth of ' end"), F.col("text")).alias("question"), (F.col("conv_id") % n).alias("doc_id"))
    rows = h.sectioned(elements(spark, sf_dir))
    parent = F.concat(F.lit("s"), F.col("doc_id"), F.lit("-"), F.col("section"))
    low = rows.filter("type <> 'heading'").select("doc_id", "seq", F.lit(2).alias("chunk_level"), F.when(F.col("seq") % 3 == 0, "table").otherwise("paragraph").alias("element_type"), F.concat(F.lit("e"), F.col("doc_id"), F.lit("-"), F.col("seq")).alias("chunk_hash"), parent.alias("parent_chunk_id"))
    high = rows.select("doc_id", "section").distinct().select("doc_id", (F.col("section") + 10000).alias("seq"), F.lit(1).alias("chunk_level"), F.lit("section").alias("element_type"), parent.alias("chunk_hash"), F.lit(None).cast("string").alias("parent_chunk_id"))
    w = Window.partitionBy("doc_id").orderBy(F.md5("chunk_hash"), "chunk_hash")
    cand = low.unionByName(high).withColumn("rank", F.row_number().over(w)).filter("rank <= 12").withColumn("id", F.col("doc_id") * 100000 + F.col("seq"))
    return asked.join(cand, "doc_id")


WANT = "CASE WHEN regexp_matches(lower(question), 'table|row|column|compare|vs|versus|list of') THEN 'table' WHEN regexp_matches(lower(question), 'overview|summary|introduction|what is|about') THEN 'overview' END"
ORDERED = f"""{POOL}, ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(({WANT} = 'table' AND element_type = 'table') OR ({WANT} = 'overview' AND chunk_level = 1), false)::INT DESC, rank) AS place FROM pool)"""


@register("r5_reordered", f"WITH {ORDERED} SELECT query_id, id, place FROM ordered")
def r5_reordered(spark, sf_dir):
    return h.reordered(pool(spark, sf_dir)).select("query_id", "id", "place")


@register("r5_hierarchical")
def r5(spark, sf_dir):
    return h.expanded(h.reordered(pool(spark, sf_dir)), 4)


@register("j7_parents", f"WITH {POOL} SELECT c.query_id, c.chunk_hash, p.chunk_hash AS parent_hash FROM pool c JOIN pool p ON p.query_id = c.query_id AND p.chunk_hash = c.parent_chunk_id WHERE c.chunk_level = 2")
def j7(spark, sf_dir):
    rows = pool(spark, sf_dir)
    return h.parents_of(rows, rows)


@register("j5_scores", f"WITH {POOL}, sc AS (SELECT query_id, chunk_hash, 1.0 / rank AS score FROM pool WHERE rank <= 5) SELECT query_id, chunk_hash, round(score, 6) AS score FROM pool LEFT JOIN sc USING (query_id, chunk_hash) WHERE rank > 2")
def j5(spark, sf_dir):
    rows = pool(spark, sf_dir)
    scored = rows.filter("rank <= 5").select("query_id", "chunk_hash", "rank", (1 / F.col("rank")).alias("score"))
    return h.with_scores(rows.filter("rank > 2").select("query_id", "chunk_hash"), scored).select("query_id", "chunk_hash", F.round("score", 6).alias("score"))


@register("a4_context", f"WITH {ORDERED} SELECT query_id, string_agg(chunk_hash, chr(10) || chr(10) ORDER BY place) AS context FROM ordered WHERE place <= 3 GROUP BY 1")
def a4(spark, sf_dir):
    rows = h.reordered(pool(spark, sf_dir)).filter("place <= 3")
    return h.context(rows.select("query_id", "place", F.col("chunk_hash").alias("page_content")))


#: A best cosine below which a question counts as weakly answered.
WEAK = 0.37
#: Answers are vectors of even labels, synthesized ones those of odd labels; a vector does not answer itself.
BOTH = f"""{DENSE_SQL}, a AS (SELECT d.*, e.label % 2 = 0 AS own FROM d JOIN embeddings e ON e.vec_id = d.id WHERE d.id <> d.query_id)"""


@register("r7_weak_answers", f"""WITH {BOTH}, l AS (SELECT * FROM a WHERE own QUALIFY max(score) OVER (PARTITION BY query_id) < {WEAK}),
  lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM l), yr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM a WHERE NOT own AND query_id IN (SELECT query_id FROM l))
  SELECT query_id, id, r::INT AS place, 'documents' AS origin FROM lr WHERE r <= 3 UNION ALL SELECT query_id, id, (r + 3)::INT, 'synthesized' FROM yr WHERE r <= 3""")
def r7(spark, sf_dir):
    all_, q = vectors(spark, sf_dir)
    best = lambda of: r.nearest(all_.filter(of), q, 3, others=True)
    return h.weak_answers(best("label % 2 = 0"), best("label % 2 <> 0"), WEAK, 3, True)


@register("r4_reranked", HYBRID_SQL.format(k=12, columns="query_id, id, rank", rows="x WHERE rank <= 4"))
def r4(spark, sf_dir):
    """Hybrid retrieval of twelve, handed to the reranker, which keeps four."""
    plans = {"hybrid_rerank": lambda: h.identity_rerank(hybrid(spark, sf_dir, 12), 4)}
    return h.selected("hybrid_rerank", plans).select("query_id", "id", "rank")


REFUSAL = "I can't find that in the documents."


@register("x9_refusals", f"""WITH p AS (SELECT c.conv_id, c.turn, c.text AS answer, {TOKENS('c.text')} AS said, {TOKENS('b.text')} AS known FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40 WHERE role = 'assistant'),
  z AS (SELECT *, len(known) = 0 OR len(said) = 0 OR len(list_intersect(said, known)) = 0 AS never FROM p)
  SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND never THEN '{REFUSAL.replace("'", "''")}' ELSE answer END AS answer, CASE WHEN turn % 2 = 1 AND never THEN []::VARCHAR[] ELSE [conv_id::VARCHAR] END AS sources FROM z""")
def x9(spark, sf_dir):
    """Strict answers that share no word with what they rest on are refused."""
    items = read(spark, sf_dir, "benchmark").select("item_id", t.content_tokens(F.col("text")).alias("known"))
    said = read(spark, sf_dir, "conversations").filter("role = 'assistant'").join(items, F.col("conv_id") % 40 == F.col("item_id"))
    shared = F.size(F.array_intersect(t.content_tokens(F.col("text")), F.col("known"))) > 0
    rows = said.select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, "strict").otherwise("open").alias("mode"), shared.cast("double").alias("score"), F.col("text").alias("answer"), F.array(F.col("conv_id").cast("string")).alias("sources"))
    return h.refused(rows, 0.5, REFUSAL).select("conv_id", "turn", "answer", "sources")


@register("a7_gate", "WITH m AS (SELECT source AS strategy, avg(n_chars) AS a, avg((lang = 'en')::INT) AS b FROM documents GROUP BY 1), k AS (SELECT * FROM m WHERE strategy = (SELECT min(strategy) FROM m)) SELECT m.strategy, m.a > k.a OR m.b > k.b AS passed FROM m, k WHERE m.strategy <> k.strategy")
def a7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    metrics = docs.groupBy(F.col("source").alias("strategy")).agg(F.avg("n_chars").alias("a"), F.avg((F.col("lang") == "en").cast("int")).alias("b"))
    return ops.compared(metrics, docs.agg(F.min("source")).first()[0])


@register("x10_review", """WITH v AS (SELECT conv_id, arg_max(turn % 3 = 0, (turn, turn % 3 <> 0)) AS approve FROM conversations WHERE turn > 2 GROUP BY 1), p AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT 'e' || conv_id AS entry_id, CASE WHEN approve THEN 'approved' WHEN approve IS NULL THEN 'pending' END AS state FROM p LEFT JOIN v USING (conv_id) WHERE approve IS NULL OR approve""")
def x10(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    name = F.concat(F.lit("e"), F.col("conv_id"))
    queued = turns.select(name.alias("entry_id"), F.lit("q").alias("question"), F.lit(" a ").alias("answer"), F.lit(0.1).alias("best_score"))
    verdicts = turns.filter("turn > 2").select(name.alias("entry_id"), (F.col("turn") % 3 == 0).alias("approve"), F.col("turn").alias("ts"))
    approved, left = ops.reviewed(queued, verdicts, F.lit("2024-01-01T00:00:00Z"))
    return approved.select("entry_id", F.lit("approved").alias("state")).unionByName(left.select("entry_id", F.lit("pending").alias("state")))


@register("x3_locks", """WITH j AS (SELECT event_id AS seq, user_id AS file_name, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), l AS (SELECT DISTINCT user_id AS file_name FROM events WHERE event_id % 50 = 0 AND ts + INTERVAL 600 SECOND > TIMESTAMP '2024-01-15 00:00:00')
  SELECT seq, CASE WHEN file_name IN (SELECT file_name FROM l) OR row_number() OVER (PARTITION BY file_name ORDER BY seq) > 1 THEN 'skipped' ELSE 'run' END AS status FROM j""")
def x3(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    jobs = events.filter(F.col("event_type") == events.agg(F.min("event_type")).first()[0]).select(F.col("event_id").alias("seq"), F.col("user_id").alias("file_name"))
    locks = events.filter("event_id % 50 = 0").select(F.col("user_id").alias("file_name"), F.col("ts").alias("locked_at"))
    return ops.claimed(jobs, locks, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz" if dict(events.dtypes)["ts"] == "timestamp_ntz" else "timestamp")).select("seq", "status")


@register("x2_attempts", "SELECT event_id, CASE WHEN value < 50 THEN 'done' WHEN event_id % 3 > 0 AND event_id % 4 + 1 < 3 THEN 'retry' ELSE 'failed' END AS status, event_id % 4 + 1 AS attempts FROM events")
def x2(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").select("event_id", (F.col("value") < 50).alias("ok"), (F.col("event_id") % 3 > 0).alias("again"), (F.col("event_id") % 4).alias("attempts"))
    return ops.attempted(jobs).select("event_id", "status", "attempts")


@register("e2_embeddings", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
  p AS (SELECT doc_id, list_transform(w, lambda x: cast('0x' || substr(md5(x), 1, 4) AS INT) % 16) AS p FROM w), c AS (SELECT doc_id, list_transform(range(16), lambda i: len(list_filter(p, lambda x: x = i))::DOUBLE) AS c FROM p)
  SELECT doc_id, list_transform(c, lambda x: round(coalesce(x / nullif(sqrt(list_dot_product(c, c)), 0), 0), 6)) AS embedding FROM c""")
def e2(spark, sf_dir):
    from docuflux.operators import providers

    embed = providers.EMBEDDERS.make("hash")
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(embed(F.col("text")), lambda x: F.round(x, 6)).alias("embedding"))


@register("t5_reranked", f"""WITH q AS (SELECT d.doc_id AS id, b.item_id AS query_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank, {TOKENS('b.text')} AS asked, {TOKENS('d.text')} AS said FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
  s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(said, asked)) / greatest(len(asked), 1) DESC, rank) AS new_rank FROM q) SELECT query_id, id, new_rank FROM s WHERE new_rank <= 3""")
def t5(spark, sf_dir):
    from docuflux.operators import providers

    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = read(spark, sf_dir, "documents").join(items, F.col("doc_id") % 40 == F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    ranked = docs.select("query_id", F.col("doc_id").alias("id"), rank.alias("rank"), "question", F.col("text").alias("page_content"))
    return providers.RERANKERS.make("overlap")(ranked, 3).select("query_id", "id", "new_rank")
