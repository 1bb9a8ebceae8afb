"""Queries of the guards and parsers over pages, conversations, events and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.functions import guards as g
from docuflux.registry import register

from .text import Q, STRIP, read

NETS = ["10.0.0.0/8", "192.168.1.7", "172.16.0.0/12", "no/net"]
ALLOWED = ["example.com", "docs.example.org"]


def quad(number):
    return F.concat_ws(".", *[F.pmod(F.floor(number / d), F.lit(256)).cast("long").cast("string") for d in (1 << 24, 1 << 16, 256, 1)])


QUAD = "(({n} // 16777216) % 256 || '.' || ({n} // 65536) % 256 || '.' || ({n} // 256) % 256 || '.' || {n} % 256)"
#: Addresses that meet every network: a few of each kind, then spread ones.
SEEDS = [0, 10 * 2**24 + 5, 127 * 2**24 + 1, 169 * 2**24 + 254 * 2**16 + 169 * 256 + 254, 172 * 2**24 + 20 * 2**16, 192 * 2**24 + 168 * 2**16 + 263, 224 * 2**24 + 9, 8 * 2**24 + 8 * 2**16 + 2056]
NUMBER = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SEEDS)) + " ELSE event_id * 2654435761 % 4294967296 END"


def addresses(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", quad(F.expr(NUMBER.replace("//", "/"))).alias("ip"), F.col("user_id").cast("string").alias("who"))


@register("f6_names", rf"""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  page ' || page_id || ' ' WHEN 2 THEN '   ' ELSE repeat('n', 100 + page_id % 60) END AS raw FROM pages),
  s AS (SELECT page_id, {STRIP('raw')} AS s FROM n)
  SELECT page_id, CASE WHEN length(s) = 0 THEN 'empty' WHEN regexp_matches(s, '[/\\.]') THEN 'separator' WHEN length(s) > 128 THEN 'long' END AS error FROM s""")
def f6(spark, sf_dir):
    raw = F.expr("case page_id % 4 when 0 then url when 1 then concat('  page ', page_id, ' ') when 2 then '   ' else repeat('n', cast(100 + page_id % 60 as int)) end")
    return read(spark, sf_dir, "pages").select("page_id", g.name_error(raw).alias("error"))


BLOCKED = " OR ".join(f"n BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)}" for net in map(g.ipaddress.ip_network, g.BLOCKED_V4))


@register("s11_url_guard", f"""WITH a AS (SELECT event_id, {NUMBER} AS n FROM events),
  h AS (SELECT *, CASE event_id % 5 WHEN 3 THEN 'example.com' WHEN 4 THEN 'localhost' ELSE {QUAD.format(n='n')} END AS host FROM a)
  SELECT event_id, host, CASE WHEN (event_id % 5 < 3 AND ({BLOCKED})) OR host = 'localhost' THEN 'internal' END AS open_error,
    CASE WHEN host = 'example.com' THEN NULL WHEN (event_id % 5 < 3 AND ({BLOCKED})) OR host = 'localhost' THEN 'internal' ELSE 'unlisted' END AS listed_error FROM h""")
def s11(spark, sf_dir):
    host = F.expr("case event_id % 5 when 3 then 'example.com' when 4 then 'localhost' else ip end")
    url = F.concat(F.lit("https://user@"), host, F.lit(":8443/a/b.pdf?x=1#y"))
    return addresses(spark, sf_dir).select("event_id", g.host_of(url).alias("host"), g.url_error(url, ["*"]).alias("open_error"), g.url_error(url, ALLOWED).alias("listed_error"))


@register("f33_client_address", f"""WITH a AS (SELECT event_id, {NUMBER} AS n, user_id FROM events), i AS (SELECT *, {QUAD.format(n='n')} AS ip FROM a)
  SELECT event_id, CASE WHEN NOT (n BETWEEN 167772160 AND 184549375 OR ip = '192.168.1.7' OR n BETWEEN 2886729728 AND 2887778303) THEN ip
    WHEN event_id % 2 = 0 THEN 'hop' || user_id WHEN event_id % 3 = 0 THEN 'real' || user_id ELSE ip END AS client FROM i""")
def f33(spark, sf_dir):
    forwarded = F.expr("case when event_id % 2 = 0 then concat('1.2.3.4, hop', who, ' ') end")
    real = F.expr("case when event_id % 3 = 0 then concat('real', who) else '' end")
    return addresses(spark, sf_dir).select("event_id", g.client_address(F.col("ip"), forwarded, real, NETS).alias("client"))


@register("s12_path_guard", """SELECT page_id, p AS path, (starts_with(p, '/data/in/') OR p = '/data/in') AND page_id % 5 <> 1 AS allowed
  FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/data/in/' || page_id || '.pdf' WHEN 1 THEN '/data/in/../etc/' || page_id WHEN 2 THEN '/data/inner/x' WHEN 3 THEN '/data/in' ELSE 'data/in/x' END AS p FROM pages)""")
def s12(spark, sf_dir):
    path = F.expr("case page_id % 5 when 0 then concat('/data/in/', page_id, '.pdf') when 1 then concat('/data/in/../etc/', page_id) when 2 then '/data/inner/x' when 3 then '/data/in' else 'data/in/x' end")
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), g.path_allowed(path, ["/data/in/"]).alias("allowed"))


@register("s10_size_cap", "SELECT page_id, octet_length(encode(html)) AS bytes, octet_length(encode(html)) <= 2000 AS accepted FROM pages")
def s10(spark, sf_dir):
    size = F.octet_length("html").cast("long")
    return read(spark, sf_dir, "pages").select("page_id", size.alias("bytes"), (size <= 2000).alias("accepted"))


@register("s13_page_lists", r"""WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '1,3,5-7' WHEN 1 THEN '2-2,9-12,4' WHEN 2 THEN '3-' ELSE '11' END AS spec FROM pages),
  p AS (SELECT page_id, unnest(string_split(spec, ',')) AS part FROM l WHERE regexp_matches(spec, '^\d+(-\d+)?(,\d+(-\d+)?)*$')),
  r AS (SELECT page_id, unnest(range(string_split(part, '-')[1]::INT, string_split(part, '-')[-1]::INT + 1))::INT AS page FROM p)
  SELECT DISTINCT page_id, page FROM r WHERE page <= 10""")
def s13(spark, sf_dir):
    from docuflux.operators import operations as ops

    spec = F.expr("case page_id % 4 when 0 then '1,3,5-7' when 1 then '2-2,9-12,4' when 2 then '3-' else '11' end")
    asked = read(spark, sf_dir, "pages").withColumn("spec", spec).filter(g.pages_valid(F.col("spec"))).select("page_id", F.explode(ops.page_numbers(F.col("spec"))).alias("page"))
    return asked.join(F.broadcast(spark.range(1, 11).select(F.col("id").cast("int").alias("page"))), "page", "left_semi").select("page_id", "page")


@register("f21_unknown", "SELECT doc_id, md5(replace(text, chr(65533), '?')) AS replaced, md5(text) AS untouched FROM documents")
def f21(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(g.replaced_unknown(text, "?")).alias("replaced"), F.md5(g.replaced_unknown(text, "�")).alias("untouched"))


@register("f23_boxes", """WITH b AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN [embedding[1], embedding[2], embedding[3], embedding[4]]::DOUBLE[] WHEN 1 THEN [1.0, 2.0, 3.0]::DOUBLE[] WHEN 2 THEN [1.0, 'nan'::DOUBLE, 3.0, 4.0] ELSE [1.0, 2.0, 'inf'::DOUBLE, 4.0] END AS b FROM embeddings)
  SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN b END AS box FROM b""")
def f23(spark, sf_dir):
    e = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    given = F.when(F.col("vec_id") % 4 == 0, e).when(F.col("vec_id") % 4 == 1, F.array(*map(F.lit, (1.0, 2.0, 3.0)))).when(F.col("vec_id") % 4 == 2, F.array(*map(F.lit, (1.0, float("nan"), 3.0, 4.0)))).otherwise(F.array(*map(F.lit, (1.0, 2.0, float("inf"), 4.0))))
    return read(spark, sf_dir, "embeddings").select("vec_id", g.box(given).alias("box"))


@register("f25_private_use", "SELECT doc_id, md5(text || 'end') AS plain FROM documents")
def f25(spark, sf_dir):
    marked = F.concat(F.col("text"), F.lit("end\U000f0001"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(g.without_private_use(marked)).alias("plain"))


@register("f28_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def f28(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", g.iso_utc(F.col("ts")).alias("iso"))


@register("f30_prompts", f"""WITH c AS (SELECT conv_id, turn, text, CASE turn % 5 {' '.join(f"WHEN {i} THEN {Q(m)}" for i, m in enumerate(g.MODES))} ELSE 'other' END AS mode FROM conversations WHERE role = 'user')
  SELECT conv_id, turn, CASE mode {' '.join(f"WHEN {Q(m)} THEN {Q(t)}" for m, t in g.MODES.items())} ELSE {Q(g.MODES['strict'])} END || chr(10) || chr(10) || 'Answer in English.' ||
    CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'History:' || chr(10) || 'User: ' || text ELSE '' END || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM c""")
def f30(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'")
    mode = F.expr("case turn % 5 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(g.MODES)) + " else 'other' end")
    history = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("User: "), F.col("text"))).otherwise(F.lit("  "))
    return asked.select("conv_id", "turn", g.prompt(mode, F.lit("English"), F.lit(None).cast("string"), history, F.lit(""), F.col("text")).alias("prompt"))


@register("f31_verdicts", """SELECT event_id, event_id % 4 <> 1 AS grounded FROM events""")
def f31(spark, sf_dir):
    raw = F.expr("""case event_id % 4 when 0 then concat('Verdict:\n{"grounded": true, "n": ', event_id, '}\nend') when 1 then '{"grounded": false}' when 2 then 'no json {' else '{"grounded": "yes"}' end""")
    return read(spark, sf_dir, "events").select("event_id", g.grounded(raw).alias("grounded"))


@register("f32_citations", """SELECT page_id, 'Source: ' || CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE url END || CASE WHEN page_id % 4 > 0 THEN ', Page ' || page_id % 4 ELSE '' END ||
  CASE WHEN page_id % 2 = 0 THEN ', Position (' || page_id || ', 17)' ELSE '' END AS citation FROM pages""")
def f32(spark, sf_dir):
    source = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    bbox = F.when(F.col("page_id") % 2 == 0, F.array(F.col("page_id") + 0.25, F.lit(16.75), F.lit(1.0), F.lit(1.0)))
    return read(spark, sf_dir, "pages").select("page_id", g.citation(source, F.col("page_id") % 4, bbox).alias("citation"))


ERRORS = "CASE page_id % 3 WHEN 0 THEN ['Page 7: bad', 'page 3: no', 'Page 12', 'Page 7: again'] WHEN 1 THEN ['x Page 4: y'] ELSE ['Page 2', 'Page 5 of 9'] END"


@register("b12_failed_pages", f"""WITH e AS (SELECT page_id, unnest(CASE page_id % 3 WHEN 0 THEN [7, 12] WHEN 1 THEN [] ELSE [2] END || list_filter(range(1, 9), lambda p: (p + page_id) % 4 = 0)) AS page FROM pages)
  SELECT page_id, list_sort(list(DISTINCT page::INT)) AS failed FROM e GROUP BY 1""")
def b12(spark, sf_dir):
    """Pages that errors name, and those of 1 to 8 that are not present."""
    errors = F.expr("case page_id % 3 when 0 then array('Page 7: bad', 'page 3: no', 'Page 12', 'Page 7: again') when 1 then array('x Page 4: y') else array('Page 2', 'Page 5 of 9') end")
    pages = read(spark, sf_dir, "pages").select("page_id", g.failed_pages(errors).alias("named"))
    there = F.filter(F.sequence(F.lit(1), F.lit(8)), lambda p: (p + F.col("page_id")) % 4 != 0)
    return pages.select("page_id", F.array_sort(F.array_union("named", F.array_except(F.sequence(F.lit(1), F.lit(8)), there))).alias("failed"))


@register("f36_contexts", r"""SELECT doc_id, list_transform(CASE WHEN len(p) = 0 THEN [''] ELSE p END, lambda x: md5(x)) AS parts FROM
  (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0) AS p FROM documents)""")
def f36(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(g.contexts(F.col("text")), F.md5).alias("parts"))


HINT = " OR ".join(f"contains(lower(kind), '{h}')" for h in g.TRANSIENT_HINTS)


@register("x8_backoff", f"""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'HTTPError' ELSE 'APIConnectionError' END AS kind,
    CASE WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 8 = 2 THEN 503 ELSE 404 END END AS status, event_id % 6 + 1 AS attempt FROM events)
  SELECT event_id, coalesce(status IN (429, 500, 502, 503, 504), false) OR {HINT} AS again, least(0.5 * power(2, attempt - 1), 8.0)::DOUBLE AS wait_s FROM e""")
def x8(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.expr("case event_id % 4 when 0 then 'ReadTimeout' when 1 then 'ValueError' when 2 then 'HTTPError' else 'APIConnectionError' end")
    status = F.expr("case when event_id % 4 = 2 then case when event_id % 8 = 2 then 503 else 404 end end")
    return e.select("event_id", g.transient(kind, status).alias("again"), g.backoff(F.col("event_id") % 6 + 1, 0.5, 8.0).alias("wait_s"))


@register("p10_kept_answers", rf"""SELECT conv_id, turn, 'synthesized:' || substr(sha256('q' || conv_id || text), 1, 12) AS entry FROM conversations
  WHERE role = 'assistant' AND turn % 4 <> 0 AND (conv_id % 10) / 10.0 < 0.35 AND length({STRIP('text')}) >= 50""")
def p10(spark, sf_dir):
    from docuflux.functions import text as t

    said = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    mode = F.when(F.col("turn") % 4 == 0, "strict").otherwise("learning")
    kept = said.filter(g.kept_answer(mode, F.col("conv_id") % 10 / 10, F.col("text"), 0.35, 50))
    return kept.select("conv_id", "turn", t.entry_id(F.concat(F.lit("q"), F.col("conv_id")), F.col("text")).alias("entry"))


@register("b9_bullets", r"SELECT conv_id, turn, length(regexp_extract(b || text, '^\s*(?:[•◦▪‣·*+-]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+')) AS n FROM (SELECT *, CASE turn % 5 WHEN 0 THEN '• ' WHEN 1 THEN '12) ' WHEN 2 THEN '  (a)  ' WHEN 3 THEN '-' ELSE '' END AS b FROM conversations)")
def b9(spark, sf_dir):
    mark = F.expr("case turn % 5 when 0 then '• ' when 1 then '12) ' when 2 then '  (a)  ' when 3 then '-' else '' end")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", g.bullet_length(F.concat(mark, F.col("text"))).alias("n"))


@register("b8_script", r"SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'ko' ELSE 'en' END AS script FROM documents")
def b8(spark, sf_dir):
    from docuflux.functions import text as t

    marked = F.when(F.col("doc_id") % 3 == 1, F.concat(F.col("text"), F.lit(" 한글 漢字"))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", t.script_language(marked).alias("script"))


@register("f24_versions", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 8 WHEN 1 THEN (9 + page_id)::INT WHEN 2 THEN NULL ELSE 17 END AS major FROM pages")
def f24(spark, sf_dir):
    from docuflux.functions import text as t

    said = F.expr("case page_id % 4 when 0 then concat('1.8.0_', page_id) when 1 then cast(9 + page_id as string) when 2 then 'java' else '17.0.2' end")
    return read(spark, sf_dir, "pages").select("page_id", t.version_major(said).alias("major"))


@register("f8_answer_cap", r"SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(regexp_replace(substr(text, 1, 60), ' [^ ]*$', ''), '\s+$', '') || '…' END AS answer, length(text) > 60 AS truncated FROM conversations")
def f8(spark, sf_dir):
    from docuflux.functions import text as t

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.shortened(F.col("text"), 60).alias("answer"), (F.length("text") > 60).alias("truncated"))
