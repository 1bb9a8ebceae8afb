"""Queries of parsers over what the documents and conversations say: versions, verdicts, errors, page lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.functions import guards as g
from docuflux.functions import text as t
from docuflux.operators import operations as ops
from docuflux.registry import register

from .text import read

NUMBERS = r"[0-9]+(?:\.[0-9]+)*"


@register("f24_versions_said", rf"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{NUMBERS}')) AS said FROM documents), m AS (SELECT doc_id, said, CASE WHEN regexp_matches(said, '^1\.[0-9]') THEN regexp_extract(said, '^1\.([0-9]+)', 1) ELSE regexp_extract(said, '^([0-9]+)', 1) END AS m FROM n)
  SELECT doc_id, said, try_cast(m AS INT) AS major, count(*) AS n FROM m GROUP BY ALL""")
def f24_said(spark, sf_dir):
    """Every number of the documents as a version; what is too long for one has none."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0))).alias("said"))
    return rows.withColumn("major", t.version_major(F.col("said"))).groupBy("doc_id", "said", "major").agg(F.count("*").alias("n"))


@register("f31_verdicts_said", "SELECT conv_id, turn, coalesce(contains(text, '{'), false) OR length(text) % 3 > 0 AS grounded FROM conversations WHERE role = 'assistant'")
def f31_said(spark, sf_dir):
    """A judge that repeats the answer, before its verdict and quoted within: the verdict is that of the answer's length."""
    said = F.to_json(F.struct(F.col("text").alias("answer"), (F.length("text") % 3 > 0).alias("grounded")))
    rows = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", g.grounded(F.concat("text", F.lit("\nVerdict: "), said, F.lit("\ndone."))).alias("grounded"))


#: Pages of ten lines, and lines with runs of signs, which no reader gets right.
BROKEN = r"[#$%&*]{3}|!!"
ERRORS = f"""b AS (SELECT DISTINCT doc_id, s // 10 + 1 AS page FROM (SELECT doc_id, unnest(range(len(x))) AS s, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE regexp_matches(l, '{BROKEN}'))"""


def errors(spark, sf_dir):
    """(doc_id, errors): a message for each line that is broken, with the line in it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("s", "l")).filter(F.rlike("l", F.lit(BROKEN)))
    said = F.concat(F.lit("Page "), F.floor(F.col("s") / 10) + 1, F.lit(": can't read "), F.col("l"))
    return rows.groupBy("doc_id").agg(F.collect_list(said).alias("errors"))


@register("b12_pages_said", f"WITH {ERRORS} SELECT doc_id, list_sort(list(page::INT)) AS failed FROM b GROUP BY 1")
def b12_said(spark, sf_dir):
    return errors(spark, sf_dir).select("doc_id", g.failed_pages(F.col("errors")).alias("failed"))


@register("s13_pages_said", f"""WITH {ERRORS}, r AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS run FROM b), i AS (SELECT doc_id, min(page) AS a, max(page) AS z FROM r GROUP BY doc_id, run)
  SELECT doc_id, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ',' ORDER BY a) AS spec, true AS valid, (SELECT list_sort(list(page::INT)) FROM b WHERE b.doc_id = i.doc_id) AS pages FROM i GROUP BY doc_id""")
def s13_said(spark, sf_dir):
    """The failed pages of each document as a list of pages and ranges, read again."""
    rows = b12_said(spark, sf_dir).select("doc_id", F.explode("failed").alias("page"))
    run = rows.withColumn("run", F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    part = run.groupBy("doc_id", "run").agg(F.min("page").alias("a"), F.max("page").alias("z"))
    said = F.when(F.col("a") == F.col("z"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "z"))
    listed = part.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", said.alias("said")))).alias("parts"))
    spec = listed.select("doc_id", F.array_join(F.transform("parts", lambda p: p["said"]), ",").alias("spec"))
    return spec.select("doc_id", "spec", g.pages_valid(F.col("spec")).alias("valid"), ops.page_numbers(F.col("spec")).alias("pages"))


@register("f34_clean_json", r"""SELECT doc_id, md5(replace(text, 'a', chr(65533))) AS cleaned, length(text) AS n FROM documents""")
def f34_clean(spark, sf_dir):
    """Whole texts in which every a has become a null character, cleaned."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("a"), F.lit("\x00")).alias("text"))
    return rows.select("doc_id", F.md5(g.without_nulls(F.col("text"))).alias("cleaned"), F.length("text").cast("long").alias("n"))
