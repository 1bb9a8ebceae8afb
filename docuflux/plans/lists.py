"""Queries of lists: the lines of all documents with labels that hang on their place, in ten kinds by document."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.operators import lists as ls
from docuflux.registry import register

from .text import read

ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]


def labelled(spark, sf_dir):
    """Ten lines to a page: a header, five items of a list that goes on over pages (a dash further right
    among and after them on every third page, else plain lines), and a rule. The counter begins anew
    after 14 items."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("s", "t"))
    s, kind = F.col("s"), F.col("doc_id") % 10
    place, page = s % 10, F.floor(s / 10).cast("long")
    n = ((page * 5 + F.when(place <= 3, place).otherwise(place - 1)) - 1) % 14 + 1  # places 1, 2, 3, 5 and 6
    letter = lambda first: F.chr(n + (first - 1))
    names = F.element_at(F.array(*map(F.lit, ROMAN)), n.cast("int"))
    label = (
        F.when(kind == 0, F.concat(n, F.lit(". "))).when(kind == 1, F.concat(F.lit("("), letter(97), F.lit(") "))).when(kind == 2, F.concat(names, F.lit(". "))).when(kind == 3, F.concat(F.upper(names), F.lit(") ")))
        .when(kind == 4, F.concat(F.element_at(F.array(*[F.lit(chr(0x245F + i)) for i in range(1, 15)]), n.cast("int")), F.lit(" ")))
        .when(kind == 5, F.concat(F.element_at(F.array(*[F.lit(c) for c in ls.HANGUL[0]]), n.cast("int")), F.lit(". "))).when(kind == 6, F.concat(page + 1, F.lit("."), n, F.lit(" ")))
        .when(kind == 7, F.lit("• ")).when(kind == 8, F.concat(F.lit("Article "), n, F.lit(": "))).otherwise(F.concat(letter(65), F.lit(". ")))
    )
    bullet = place.isin(4, 7) & (page % 3 == 2)
    item = place.isin(1, 2, 3, 5, 6)
    text = F.when(bullet, F.concat(F.lit("- "), "t")).when(item, F.concat(label, "t")).otherwise(F.col("t"))
    left = F.when(bullet, 70.0).when(place.isin(4, 7), 62.0).otherwise(50.0)
    what = F.when(place == 0, "header").when(place == 9, "line").when((place == 8) & (F.col("doc_id") % 2 == 0), "image").otherwise("text")
    return rows.select(
        "doc_id", page.alias("page"), s.cast("long").alias("seq"), what.alias("kind"), text.alias("text"), left.alias("x0"), (left + 100).alias("x1"), (700.0 - place * 20).alias("y0"), (710.0 - place * 20).alias("y1"), F.lit(10.0).alias("font_size")
    )


@register("w14_label_lists")
def w14_labels(spark, sf_dir):
    """Held against a plain search over whole documents in the tests."""
    return ls.items(labelled(spark, sf_dir).filter("kind = 'text'"))


@register("w13_linked_lists")
def w13(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return ls.linked(rows, ls.items(rows.filter("kind = 'text'")))
