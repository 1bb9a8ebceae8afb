"""Sections and elements as two levels of chunks, and retrieval that moves between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.functions import guards as g
from docuflux.functions import text as t
from docuflux.operators import retrieval as r
from docuflux.operators.groups import by_group, cut, flowed
from docuflux.operators.structure import OVERLAP, SIZE, split_text

# Words that a question about tables or for an overview contains, anywhere.
TABLE_TERMS = ["table", "row", "column", "compare", "vs", "versus", "list of"]
OVERVIEW_TERMS = ["overview", "summary", "introduction", "what is", "about"]
STRATEGIES = ["mmr", "hybrid", "hybrid_rerank", "hierarchical"]
# End of fixed values.
RRF_POOL, LEAST_POOL = 4, 10


def sectioned(elements: DataFrame) -> DataFrame:
    """Adds section (0 before any heading), section_title and section_level to every element.

    elements: doc_id, seq, page, type, level, content.
    """
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("type") == "heading"
    return elements.withColumns(
        {
            "section": F.sum(head.cast("int")).over(so_far),
            "section_title": F.last(F.when(head, F.col("content")), ignorenulls=True).over(so_far),
            "section_level": F.last(F.when(head, F.coalesce("level", F.lit(1))), ignorenulls=True).over(so_far),
        }
    )


def section_texts(elements: DataFrame) -> DataFrame:
    """One row for each section with text: doc_id, section, section_title, heading_level, page, page_end, text.

    The heading comes first, behind its marks, then every element that is not blank, a blank line between.
    """
    head, body = F.col("type") == "heading", t.strip(F.coalesce("content", F.lit("")))
    line = F.when(head, F.concat(F.expr("repeat('#', section_level)"), F.lit(" "), F.col("content"))).when(F.length(body) > 0, body)
    place = F.struct("seq", "page")
    rows = sectioned(elements).groupBy("doc_id", "section").agg(
        F.max("section_title").alias("section_title"),
        F.max(F.when(head, F.col("level"))).alias("heading_level"),
        F.min(place)["page"].alias("page"),
        F.max(place)["page"].alias("page_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("seq", line.alias("line"))))), lambda x: x["line"]), "\n\n").alias("text"),
    )
    return rows.filter(F.length(t.strip(F.col("text"))) > 0)


def two_levels(elements: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of level 1 (pieces of sections) and level 2 (elements), in document order: doc_id,
    chunk_level, section, seq, page, page_end, section_title, element_type, heading_level,
    page_content, chunk_hash, parent_chunk_id (of level 2: the section's first piece).

    elements as in sectioned(). Blank elements and sections give none; a null content is blank.
    """
    first = cut(section_texts(elements), "text", lambda x: split_text(x, size, overlap), "piece", "raw").withColumn("page_content", t.clean_text(F.col("raw"))).filter("page_content <> ''")
    none = F.lit(None)
    level1 = first.select(
        "doc_id", F.lit(1).alias("chunk_level"), "section", F.col("piece").alias("seq"), "page", "page_end", "section_title", F.lit("section").alias("element_type"), "heading_level",
        "page_content", F.md5("page_content").alias("chunk_hash"), none.cast("string").alias("parent_chunk_id"),
    )
    parents = first.groupBy("doc_id", "section").agg(F.min_by(F.md5("page_content"), "piece").alias("parent_chunk_id"))
    body = sectioned(elements).filter("type <> 'heading'").withColumn("page_content", t.clean_text(F.coalesce("content", F.lit("")))).filter("page_content <> ''")
    level2 = body.join(parents, ["doc_id", "section"], "left").select(
        "doc_id", F.lit(2).alias("chunk_level"), "section", "seq", "page", none.cast("int").alias("page_end"), "section_title", F.col("type").alias("element_type"), none.cast("int").alias("heading_level"),
        "page_content", F.md5("page_content").alias("chunk_hash"), "parent_chunk_id",
    )
    return level1.unionByName(level2)


def element_chunks(elements: DataFrame) -> DataFrame:
    """Paragraphs, headings and lists, each a chunk."""
    return elements.filter(F.col("type").isin("paragraph", "heading", "list")).select("doc_id", "seq", F.col("content").alias("text"), "type", "page")


def section_chunks(elements: DataFrame) -> DataFrame:
    """A heading with the paragraphs and lists under it, a line each; what stands before any
    heading has no heading and no page."""
    body = sectioned(elements).filter(F.col("type").isin("paragraph", "list", "heading")).filter((F.col("type") == "heading") | (F.length("content") > 0))
    lines = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return body.groupBy("doc_id", "section").agg(
        F.max("section_title").alias("heading"), F.max(F.when(F.col("type") == "heading", F.col("page"))).alias("page"), F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("text")
    )


def sized_chunks(elements: DataFrame, least: int = 200) -> DataFrame:
    """Neighbouring elements gathered until their lines hold `least` characters; the rest of a
    document is its last chunk: doc_id, chunk, text, pages."""

    def gather(rows: Iterator) -> Iterator[tuple]:
        lines, held, pages, n = [], 0, [], 0
        for row in rows:
            line = row.content or ""
            lines.append(line)
            held += len(line) + 1
            if row.page and row.page not in pages:
                pages.append(row.page)
            if held >= least:
                if whole := "\n".join(lines).strip():
                    yield row.doc_id, n, whole, pages
                    n += 1
                lines, held, pages = [], 0, []
        if whole := "\n".join(lines).strip():
            yield row.doc_id, n, whole, pages

    body = elements.filter(F.col("type").isin("paragraph", "heading", "list")).select("doc_id", "seq", "page", "content")
    return flowed(body, ["doc_id"], ["seq"], gather, "doc_id long, chunk int, text string, pages array<int>")


# retrieval ------------------------------------------------------------------------------------


def pool_size(top_k: int) -> int:
    """Candidates that are fetched for top_k results."""
    return max(LEAST_POOL, RRF_POOL * top_k)


def asked_for(question: Column) -> Column:
    """table, overview or null: what a question asks for; tables win."""
    low = F.lower(question)
    any_of = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(low, x))
    return F.when(any_of(TABLE_TERMS), "table").when(any_of(OVERVIEW_TERMS), "overview")


def reordered(candidates: DataFrame) -> DataFrame:
    """Candidates with what the question asks for in front, each part in its order. candidates:
    query_id, question, rank, element_type, chunk_level."""
    want = asked_for(F.col("question"))
    front = F.coalesce(((want == "table") & (F.col("element_type") == "table")) | ((want == "overview") & (F.col("chunk_level") == 1)), F.lit(False))
    w = Window.partitionBy("query_id").orderBy(F.desc(front.cast("int")), "rank")
    return candidates.withColumn("place", F.row_number().over(w))


def expanded(ordered: DataFrame, k: int) -> DataFrame:
    """(query_id, place, chunk_hash, id) of k results: each candidate once, and an element's section
    right behind it if it is a candidate, not yet taken, and there is room.

    ordered: query_id, id, place, chunk_hash, chunk_level, parent_chunk_id; one question's pool is a group.
    Chunks without a hash count by their id.
    """

    def take(rows: list[dict]) -> list[dict]:
        by_hash = {x["chunk_hash"]: x for x in rows if x["chunk_hash"]}
        seen, out = set(), []
        for x in rows:
            if len(out) >= k:
                break
            key = x["chunk_hash"] or ("id", x["id"])
            if key in seen:
                continue
            seen.add(key)
            out.append(x)
            parent = x["parent_chunk_id"]
            if x["chunk_level"] == 2 and parent and parent not in seen and parent in by_hash and len(out) < k:
                seen.add(parent)
                out.append(by_hash[parent])
        return [{"query_id": x["query_id"], "place": i + 1, "chunk_hash": x["chunk_hash"], "id": x["id"]} for i, x in enumerate(out)]

    cut = ordered.select("query_id", "id", "place", "chunk_hash", "chunk_level", "parent_chunk_id")
    return by_group(cut, ["query_id"], ["place"], take, "query_id long, place int, chunk_hash string, id long")


def with_scores(chosen: DataFrame, scored: DataFrame) -> DataFrame:
    """chosen with the score of its chunk_hash among the candidates, the last one's if it repeats; null without."""
    last = scored.groupBy("query_id", "chunk_hash").agg(F.max_by("score", "rank").alias("score"))
    return chosen.join(last, ["query_id", "chunk_hash"], "left")


def parents_of(children: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, chunk_hash, parent_hash) of elements whose section is in the pool of their question."""
    up = pool.select(F.col("query_id"), F.col("chunk_hash").alias("parent_hash")).distinct()
    low = children.filter("chunk_level = 2").select("query_id", "chunk_hash", F.col("parent_chunk_id").alias("parent_hash"))
    return low.join(up, ["query_id", "parent_hash"]).select("query_id", "chunk_hash", "parent_hash")


def context(rows: DataFrame, order: str = "place") -> DataFrame:
    """(query_id, context): page contents in order, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct(order, "page_content")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["page_content"]), "\n\n").alias("context"))


def identity_rerank(ranked: DataFrame, k: int) -> DataFrame:
    """The place of a reranking model: keeps the order and cuts."""
    return ranked.filter(F.col("rank") <= k)


def selected(strategy: str, plans: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The plan of a strategy; an unknown one fails before any store is read."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown retrieval strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    return plans[strategy]()


def weak_answers(scores: DataFrame, synthesized: DataFrame, threshold: float, k: int, learning: bool) -> DataFrame:
    """For questions whose best score is below the threshold: their k best (query_id, id, place,
    origin), and when learning, the k best synthesized answers behind them."""
    weak = scores.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") < threshold)
    low = r.top(scores.join(weak, "query_id", "left_semi"), k)
    out = low.select("query_id", "id", F.col("rank").alias("place"), F.lit("documents").alias("origin"))
    if learning:
        more = r.top(synthesized.join(low.select("query_id").distinct(), "query_id", "left_semi"), k)
        out = out.unionByName(more.select("query_id", "id", (F.col("rank") + k).alias("place"), F.lit("synthesized").alias("origin")))
    return out


def refused(answers: DataFrame, least: float, refusal: str) -> DataFrame:
    """Strict answers without support become the refusal and lose their sources. answers: mode, score, answer, sources."""
    no = (F.col("mode") == "strict") & (t.bucket(F.col("score"), least) == "unsupported")
    return answers.withColumns({"sources": F.when(no, F.array().cast("array<string>")).otherwise(F.col("sources")), "answer": F.when(no, F.lit(refusal)).otherwise(F.col("answer"))})


def judged(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """A model judge's score: 1 if grounded or unreadable, else 0."""
    return answers.withColumn("score", g.grounded(F.col(raw)).cast("double"))
