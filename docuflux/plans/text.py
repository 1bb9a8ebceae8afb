"""Queries of the text functions over documents, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.functions import text as t
from docuflux.registry import register

Q = lambda s: "'" + s.replace("'", "''") + "'"
STOP = "[" + ", ".join(map(Q, t.STOPWORDS)) + "]"
STRIP = lambda e: rf"regexp_replace(regexp_replace({e}, '^\s+', ''), '\s+$', '')"
CLEAN = STRIP(r"regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')")
TOKENS = lambda e: f"list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)))"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("f1_clean_text", f"SELECT doc_id, {CLEAN} AS clean, md5({CLEAN}) AS chunk_hash, sha256(text) AS file_hash FROM documents")
def f1(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", t.clean_text(text).alias("clean"), t.chunk_hash(text).alias("chunk_hash"), t.file_hash(text).alias("file_hash"))


@register("f4_entry_id", "SELECT doc_id, 'synthesized:' || substr(sha256(source || text), 1, 12) AS entry FROM documents")
def f4(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.entry_id(F.col("source"), F.col("text")).alias("entry"))


@register(
    "s1_extension_slug",
    r"""WITH b AS (SELECT page_id, url, split_part(split_part(url, '?', 1), '#', 1) AS p FROM pages),
    n AS (SELECT *, string_split(p, '/')[-1] AS base, string_split(url, '/')[-1] AS raw FROM b),
    e AS (SELECT *, lower(regexp_extract(base, '^.+(\.[^.]*)$', 1)) AS ext,
      regexp_replace(raw, '(?i)^(.+)\.(?:pdf|docx|html|htm|txt|md|markdown|text)$', '\1') AS stem FROM n),
    s AS (SELECT *, trim(left(trim(regexp_replace(stem, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), 128), '_') AS slug FROM e)
    SELECT page_id, ext, ext IN ('.pdf', '.docx', '.html', '.htm', '.txt', '.md', '.markdown', '.text') AS supported,
      CASE WHEN slug = '' THEN 'document' ELSE slug END AS slug FROM s""",
)
def s1(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", t.extension(url).alias("ext"), t.supported(url).alias("supported"), t.slug(url).alias("slug"))


@register(
    "f7_snippet",
    rf"""WITH b AS (SELECT doc_id, {STRIP('text')} AS b FROM documents),
    r AS (SELECT doc_id, b, {STRIP("regexp_replace(b, '^#[^\n]*\n?', '')")} AS r FROM b),
    s AS (SELECT doc_id, CASE WHEN starts_with(b, '#') AND length(r) > 0 THEN r ELSE b END AS s FROM r)
    SELECT doc_id, CASE WHEN length(s) <= 200 THEN s ELSE regexp_replace(regexp_replace(substr(s, 1, 200), ' [^ ]*$', ''), '\s+$', '') || '…' END AS snippet,
      length(s) > 200 AS was_cut FROM s""",
)
def f7(spark, sf_dir):
    out = t.snippet(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", out.alias("snippet"), out.endswith("…").alias("was_cut"))


@register("f9_mask_pii")
def f9(spark, sf_dir):
    out = t.masked(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("masked_md5"), (out != F.col("text")).alias("was_masked"))


@register(
    "f9_mask_email",
    rf"SELECT doc_id, md5(regexp_replace(text, '{t.EMAIL}', '{t.EMAIL_MASK}', 'g')) AS masked_md5 FROM documents",
)
def f9_email(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", t.EMAIL, t.EMAIL_MASK)).alias("masked_md5"))


@register(
    "f11_injection",
    "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, {Q('(?i)' + p)}) THEN {Q(p)}" for p in t.INJECTIONS) + " END AS pattern FROM conversations",
)
def f11(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.injection(F.col("text")).alias("pattern"))


@register(
    "f12_language",
    f"""WITH l AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'Arabic'
      WHEN regexp_matches(lower(text), '[{t.PORTUGUESE_LETTERS}]') THEN 'European Portuguese' ELSE 'English' END AS label FROM documents)
    SELECT doc_id, label, CASE label WHEN 'Arabic' THEN 'ar' WHEN 'European Portuguese' THEN 'pt' ELSE 'en' END AS code FROM l""",
)
def f12(spark, sf_dir):
    label = t.language(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", label.alias("label"), t.language_code(label).alias("code"))


@register("f15_content_tokens", f"SELECT doc_id, list_sort({TOKENS('text')}) AS tokens FROM documents")
def f15(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_sort(t.content_tokens(F.col("text"))).alias("tokens"))


@register(
    "f16_groundedness",
    rf"""WITH p AS (SELECT d.doc_id, d.text AS answer, {TOKENS('b.text')} AS known FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
    s AS (SELECT doc_id, known, list_filter(list_transform(string_split_regex(answer, '[.!?\n]+'), lambda x: {TOKENS('x')}), lambda x: len(x) > 0) AS s FROM p),
    g AS (SELECT doc_id, CASE WHEN len(known) = 0 OR len(s) = 0 THEN 0.0
      ELSE len(list_filter(s, lambda x: len(list_intersect(x, known)) / len(x) >= 0.6)) / len(s) END AS g FROM s)
    SELECT doc_id, round(g, 4) AS score, CASE WHEN g >= 0.5 THEN 'supported' WHEN g <= 0 THEN 'unsupported' ELSE 'partial' END AS verdict,
      CASE WHEN g >= 0.7 THEN 'high' WHEN g >= 0.4 THEN 'medium' ELSE 'low' END AS badge FROM g""",
)
def f16(spark, sf_dir):
    """Documents as answers, judged against the benchmark item of their id."""
    items = read(spark, sf_dir, "benchmark").select("item_id", t.content_tokens(F.col("text")).alias("known"))
    docs = read(spark, sf_dir, "documents").join(items, F.col("doc_id") % 40 == F.col("item_id"))
    scored = docs.select("doc_id", t.groundedness(F.col("text"), F.col("known")).alias("g"))
    return scored.select("doc_id", F.round("g", 4).alias("score"), t.bucket(F.col("g"), 0.5).alias("verdict"), t.badge(F.col("g")).alias("badge"))


@register(
    "f19_similarity",
    """SELECT a.page_id, round(CASE WHEN a.s = b.s THEN 1.0 WHEN a.s = '' OR b.s = '' THEN 0.0 ELSE 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) END, 6) AS similarity
    FROM (SELECT page_id, url AS s FROM pages) a JOIN (SELECT page_id, url AS s FROM pages) b ON b.page_id = a.page_id + 1""",
)
def f19(spark, sf_dir):
    """Each page's whole address against that of the next page."""
    urls = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("s"))
    other = urls.select((F.col("page_id") - 1).alias("page_id"), F.col("s").alias("o"))
    return urls.join(other, "page_id").select("page_id", F.round(t.similarity(F.col("s"), F.col("o")), 6).alias("similarity"))


@register("f20_replacement", "SELECT doc_id, 0.0::double + (length(text) - length(replace(text, chr(65533), ''))) / greatest(length(text), 1) AS ratio FROM documents")
def f20(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.replacement_ratio(F.col("text")).cast("double").alias("ratio"))


@register("f22_words", r"SELECT doc_id, i AS pos, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents))")
def f22(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.bm25_tokens(F.col("text"))).alias("pos", "word"))


#: Words that stand for the list a caller gives.
COMMON_WORDS = ["the", "and", "of", "que", "der", "et"]


@register(
    "f12_stopwords",
    f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'Arabic' WHEN regexp_matches(lower(text), '[{t.PORTUGUESE_LETTERS}]') THEN 'European Portuguese'
      WHEN len(w) >= 4 AND len(list_filter(w, lambda x: list_contains({[*COMMON_WORDS]}, x))) / len(w) > 0.5 THEN 'European Portuguese' ELSE 'English' END AS label FROM w""",
)
def f12_stopwords(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.language(F.col("text"), COMMON_WORDS).alias("label"))


@register("s7_dispatch", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' WHEN 3 THEN 'text' WHEN 4 THEN 'text' END AS loader FROM pages")
def s7(spark, sf_dir):
    from docuflux.sources import files

    name = F.expr("concat('a/b', page_id, case page_id % 6 when 0 then '.PDF?x=.md' when 1 then '.docx' when 2 then '.htm#.pdf' when 3 then '.txt' when 4 then '.markdown' else '.xlsx' end)")
    return read(spark, sf_dir, "pages").select("page_id", files.dispatch(t.extension(name)).alias("loader"))


@register("s6_pdf_parsers", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pypdf' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'layout' ELSE 'pypdf' END END AS parser FROM pages")
def s6(spark, sf_dir):
    from docuflux.sources import files

    asked = F.expr("case page_id % 3 when 0 then 'pypdf' when 2 then 'other' end")
    return read(spark, sf_dir, "pages").select("page_id", files.pdf_parser(asked, F.col("page_id") % 2 == 0).alias("parser"))


@register("s9_fallback", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 2 = 0 THEN 'f' END AS text, CASE WHEN doc_id % 3 = 0 THEN 'primary' WHEN doc_id % 2 = 0 THEN 'fallback' ELSE 'failed' END AS parser FROM documents")
def s9(spark, sf_dir):
    from docuflux.sources import files

    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    first = rows.select("path", F.when(F.col("doc_id") % 3 == 0, F.md5("text")).alias("text"))
    return files.with_fallback(first, rows.select("path", F.when(F.col("doc_id") % 2 == 0, "f").alias("text")))


@register("s18_keyed", "SELECT * FROM documents WHERE doc_id IN (3, 50, 77)")
def s18(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(F.col("doc_id").isin(3, 50, 77))


#: A tree for each page: a heading, a section with a paragraph and a picture, a table with a blank cell, a header.
@register("g2_tree_walk", """WITH e AS (SELECT page_id AS doc_id, unnest([0, 1, 2, 3, 4, 5]) AS seq, url FROM pages)
  SELECT doc_id, seq::INT AS seq, [1, 0, 3, 4, 5, 6][seq + 1]::INT AS id, CASE seq WHEN 0 THEN 2 ELSE 1 END::INT AS page_number, ['heading', 'section', 'paragraph', 'picture', 'table', 'list'][seq + 1] AS type,
    [url, '', 'inner', 'seen', 'a | b', 'one' || chr(10) || 'two'][seq + 1] AS content, CASE seq WHEN 0 THEN 1 END::INT AS heading_level, CASE seq WHEN 4 THEN 9 END::INT AS next_table_id FROM e""")
def g2_tree(spark, sf_dir):
    from docuflux.sources import files

    tree = F.concat(
        F.lit('{"kids":[{"type":"heading","id":1,"page number":2,"heading level":1,"content":"'), F.col("url"),
        F.lit('"},{"type":"section","kids":[{"type":"paragraph","id":3,"content":"inner"},{"type":"picture","id":4,"description":"seen"}]},{"id":8,"content":"no type"},{"type":"header","content":"h"},'
              '{"type":"table","id":5,"next table id":9,"rows":[{"cells":[{"kids":[{"type":"paragraph","content":"a"}]},{"kids":[{"type":"paragraph","content":""}]}]},{"cells":[{"kids":[{"type":"paragraph","content":"b"}]}]}]},'
              '{"type":"list","id":6,"list items":[{"content":"one"},{"kids":[{"type":"paragraph","content":"two"}]},{"content":""}]}]}'),
    )
    trees = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tree.alias("json"))
    return files.elements(trees).drop("previous_table_id")


@register("g4_table_chains", """SELECT doc_id, 1 AS id, 3 AS n_parts, 'a1' || chr(10) || 'c3' AS content, 3 AS page_end FROM documents UNION ALL SELECT doc_id, 7, 1, 'o7', 7 FROM documents""")
def g4(spark, sf_dir):
    """For each document a chain of three (the middle one blank), an orphan and a cycle of two."""
    from docuflux.operators import structure as st

    rows = [(1, 1, "a1", 2, None), (2, 2, "", 3, 1), (3, 3, "c3", None, 2), (7, 7, "o7", 99, 98), (8, 8, "x", 9, 9), (9, 9, "y", 8, 8)]
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(p).cast("long").alias("page_number"), F.lit(c).alias("content"), F.lit(n).cast("long").alias("next_table_id"), F.lit(b).cast("long").alias("previous_table_id")) for i, p, c, n, b in rows])
    return st.merged_tables(read(spark, sf_dir, "documents").select("doc_id", F.explode(parts).alias("e")).select("doc_id", "e.*"))
