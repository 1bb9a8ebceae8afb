"""Places where models and parsers plug in: registries by name, stand-ins that need no model, and the
options of a conversion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuflux.functions import text as t

DIMENSIONS = 16


class Registry:
    """Makers by name and alias; an unknown name fails and says which there are."""

    def __init__(self, kind: str):
        self.kind, self.makers, self.aliases = kind, {}, {}

    def add(self, name: str, maker: Callable, *aliases: str) -> None:
        self.makers[name] = maker
        self.aliases |= {a.lower(): name for a in (name, *aliases)}

    def make(self, name: str, **options):
        known = self.aliases.get(name.strip().lower())
        if known is None:
            raise ValueError(f"unknown {self.kind} {name!r}; one of {', '.join(sorted(self.makers))}")
        return self.makers[known](**options)


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector of unit length from the words of a text: words count in the place that the first digits of
    their MD5 name. Needs no model; a text without words is a zero vector."""
    place = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dimensions
    places = F.transform(t.bm25_tokens(F.coalesce(text, F.lit(""))), place)
    # the places are made once and bound, not again for each dimension
    counts = lambda places: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    return F.transform(F.transform(F.array(places), counts), lambda c: F.transform(c, lambda x: F.coalesce(x / F.nullif(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)), F.lit(0.0)), F.lit(0.0))))[0]


def extractive_answer(question: Column, context: Column) -> Column:
    """The context's sentence that shares most words with the question, the first of equals; a model's stand-in."""
    asked = t.content_tokens(question)
    scored = F.transform(F.split(context, r"(?<=[.!?])\s+"), lambda s, i: F.struct((-F.size(F.array_intersect(t.content_tokens(s), asked))).alias("n"), i.alias("i"), s.alias("s")))
    return F.array_min(scored)["s"]


def overlap_rerank(ranked: DataFrame, k: int) -> DataFrame:
    """A reranker without a model: by the share of the question's words in the text, then the old rank.
    ranked: query_id, id, rank, question, page_content."""
    from pyspark.sql.window import Window

    asked = t.content_tokens(F.col("question"))
    share = F.size(F.array_intersect(t.content_tokens(F.col("page_content")), asked)) / F.greatest(F.size(asked), F.lit(1))
    w = Window.partitionBy("query_id").orderBy(F.desc(share), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)


EMBEDDERS, MODELS, RERANKERS, BACKENDS = Registry("embedder"), Registry("model"), Registry("reranker"), Registry("backend")
EMBEDDERS.add("hash", lambda dimensions=DIMENSIONS: lambda text: hash_embedding(text, dimensions), "none", "test")
MODELS.add("extractive", lambda: extractive_answer, "fake", "offline")
RERANKERS.add("identity", lambda: lambda ranked, k: ranked.filter(F.col("rank") <= k), "none")
RERANKERS.add("overlap", lambda: overlap_rerank)
BACKENDS.add("off", lambda: lambda pages: pages.limit(0), "none", "")


@dataclass(frozen=True)
class Options:
    """How documents are converted; from_text reads name=value pairs and refuses what it doesn't know."""

    parser: str = "auto"
    pages: str | None = None
    hybrid: str = "off"
    hybrid_mode: str = "auto"
    table_method: str = "border"
    furniture: bool = False
    sanitize: bool = False
    filter_hidden: bool = False
    filter_off_page: bool = True
    filter_tiny: bool = True
    filter_layers: bool = True
    strikethrough: bool = False
    markdown_html: bool = False
    page_separator: str | None = None
    replacement: str = "�"
    image_format: str = "png"
    chunk_size: int = 800
    chunk_overlap: int = 100
    threads: int = 1

    @classmethod
    def from_text(cls, *pairs: str) -> Options:
        kinds, given = {f.name: type(f.default) for f in fields(cls)}, {}
        for pair in pairs:
            name, _, value = pair.partition("=")
            name = name.lstrip("-").replace("-", "_")
            if name not in kinds:
                raise ValueError(f"unknown option {name!r}")
            given[name] = value.lower() in ("", "true", "1", "yes") if kinds[name] is bool else kinds[name](value) if kinds[name] is int else value
        return replace(cls(), **given)
