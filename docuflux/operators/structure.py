"""Elements, sections, chunks and table chains of documents."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators.groups import by_group, cut
from docuflux.session import small_batches

#: Chunk size and overlap in characters, and separators from coarse to fine.
SIZE, OVERLAP, SEPARATORS = 800, 100, ["\n\n", "\n", ".", " ", ""]


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, seq, type, level, content) of headings and paragraphs in order."""
    tags = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h[1-6]|p)(?:\s[^>]*)?>.*?</(?:h[1-6]|p)>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("seq", "tag"))
    level = F.when(F.col("tag").startswith("<h"), F.substring("tag", 3, 1).cast("int"))
    content = F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", " "), r"\s+", " ")
    return rows.select("page_id", "seq", F.when(level.isNull(), "paragraph").otherwise("heading").alias("type"), level.alias("level"), F.trim(content).alias("content"))


def titled(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds section_title: the latest heading before a row; null on headings."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("type") == "heading", F.col("content")), ignorenulls=True).over(w)
    return rows.withColumn("section_title", F.when(F.col("type") != "heading", last))


def sections(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """One row for each section: a heading and what follows it; rows before any are section 0."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("section", F.sum(F.when(F.col("type") == "heading", 1).otherwise(0)).over(w))
    parts = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return cut.groupBy(key, "section").agg(
        F.min(F.when(F.col("type") == "heading", F.col("content"))).alias("title"), F.count("*").alias("n_elements"), F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content")
    )


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that a part has; a
    separator stays at the head of what follows it; neighbours share up to `overlap` characters."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        cuts = text.split(mark)
        parts = [p for p in [cuts[0], *[mark + c for c in cuts[1:]]] if p]
    else:
        parts = list(text)
    out: list[str] = []
    run: list[str] = []

    def emit() -> None:
        whole = "".join(run).strip()
        if whole:
            out.append(whole)

    held = 0
    for part in parts:
        if len(part) >= size and finer:
            emit()
            run, held = [], 0
            out += split_text(part, size, overlap, finer)
            continue
        if run and held + len(part) > size:
            emit()
            while run and (held > overlap or held + len(part) > size):
                held -= len(run.pop(0))
        run.append(part)
        held += len(part)
    emit()
    return out


def chunked(docs: DataFrame, id_: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, page_content) of every text."""
    return cut(docs.select(id_, "text"), "text", lambda x: split_text(x, size, overlap), "chunk_index", "page_content")


class _Text(HTMLParser):
    SKIPPED = {"script", "style", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIPPED

    def handle_endtag(self, tag):
        if tag in self.SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str:
    """Visible text nodes, stripped, joined by one space."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return " ".join(parser.parts)


def loaded_html(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(html_text)

    return pages.select("page_id", text("html").alias("text"))


# Rules in order; each pattern is replaced by its stand-in.
RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "email@example.com"),
    (r"[+]\d+(?:-\d+)+", "+00-0000-0000"),
    (r"[A-Z]{1,2}\d{6,9}", "AA0000000"),
    (r"\b\d{4}-?\d{4}-?\d{4}-?\d{4}\b", "0000-0000-0000-0000"),
    (r"\b\d{10,18}\b", "0000000000000000"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "0.0.0.0"),
    (r"\b([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\b", "0.0.0.0::1"),
    (r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", "00:00:00:00:00:00"),
    (r"\b\d{15}\b", "000000000000000"),
    (r"https?://[A-Za-z0-9.-]+(:\d+)?(/\S*)?", "https://example.com"),
]
# End of fixed values.
COMPILED = [(re.compile(p, re.ASCII), new) for p, new in RULES]


def sanitized_text(text: str) -> str:
    """All rules match the given text; of overlapping matches the earliest, then longest, then
    first rule's holds; they are replaced at once."""
    hits = [(m.start(), -m.end(), i, new) for i, (p, new) in enumerate(COMPILED) for m in p.finditer(text) if m.end() > m.start()]
    out, at = [], 0
    for start, minus_end, _, new in sorted(hits):
        if start >= at:
            out += [text[at:start], new]
            at = -minus_end
    return "".join([*out, text[at:]])


def sanitized(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else sanitized_text(x))

    return docs.withColumn("text", clean("text"))


def merged_tables(rows: DataFrame) -> DataFrame:
    """Table fragments joined along next_table_id: doc_id, id, n_parts, content, page_end.

    rows: doc_id, id, page_number, content, next_table_id, previous_table_id. A fragment whose
    predecessor is absent is a head; a chain ends before a fragment that it holds already, or at an
    id that is absent; a mere cycle has no head and gives nothing. A
    document's fragments are a group.
    """
    own = rows.select("doc_id", "id", F.col("next_table_id").alias("next"), F.col("previous_table_id").alias("before"), "page_number", "content")

    def chains(part: list[dict]) -> list[dict]:
        by = {r["id"]: r for r in part}
        out = []
        for head in (r for r in part if r["before"] not in by):
            seen, at = [], head["id"]
            while at in by and at not in seen:
                seen.append(at)
                at = by[at]["next"]
            texts = [by[c]["content"] for c in seen if by[c]["content"]]
            out.append({"doc_id": head["doc_id"], "id": head["id"], "n_parts": len(seen), "content": "\n".join(texts), "page_end": by[seen[-1]]["page_number"]})
        return out

    return by_group(own, ["doc_id"], ["id"], chains, "doc_id long, id long, n_parts long, content string, page_end long")
