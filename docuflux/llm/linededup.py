"""Substring dedup by line hashing: units are lines, cut further after . ! ? , ; : before white
space, as passages are also copied into the middle of lines. From each unit the shortest run of
units with `min_words` words is hashed, so that short lines and sentences count together with
their neighbours. Runs are normalised (A-Z lower-cased, white space to one space) and digested;
digests are grouped over the whole corpus; the occurrence that ranks first (doc_id, then row, then
place) stays, also where other repeats overlap it: what repeats cover and no first occurrence does
makes stretches, and those of `least` words or more are removed. Shorter ones, which are met by
chance or are set phrases, stay.

Passages whose own units are all cut elsewhere in the other text (one long clause with other words
on the same line) are no units and are not found.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, maybe_broadcast, text_slices

#: Words of a hashed run, and words of a stretch that is removed, at least.
MIN_WORDS, LEAST = 8, 25
#: Digests are grouped in so many passes, each with its part of them, so that no more than that part is shuffled at a time.
PASSES = 2
ENDS = np.isin(np.arange(256), list(b".!?,;:"))
FIELDS = ["doc_id", "row", "at", "words", "start", "end", "h1", "h2"]
TYPES = ", ".join(f"{c} long" for c in FIELDS)


def places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes."""
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def runs(text: bytes, min_words: int) -> tuple[np.ndarray, ...]:
    """at, words (in words), start, end (in code points), h1 and h2 of each unit's run."""
    raw = np.frombuffer(text, np.uint8)
    start, end = places(raw)
    n = len(start)
    if n < min_words:
        return tuple(np.empty(0, np.int64) for _ in FIELDS[2:])
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    cut = ENDS[raw[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]])
    stops = np.append(np.flatnonzero(cut) + 1, n)
    first = np.concatenate([[0], stops[:-1]])
    to = np.searchsorted(stops, first + min_words)
    first, to = first[to < len(stops)], stops[to[to < len(stops)]]
    words = text.lower().split()
    digests = b"".join([xxhash.xxh3_128_digest(b" ".join(words[a:b])) for a, b in zip(first.tolist(), to.tolist(), strict=True)])
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    a, b = start[first], end[to - 1]
    if not text.isascii():
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        a, b = points[a], points[b]
    return first, to - first, a, b, halves[:, 0], halves[:, 1]


def _worker(min_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            found = [runs(text or b"", min_words) for text in texts]
            sizes = np.array([len(f[0]) for f in found])
            take = pa.array(np.repeat(np.arange(len(texts)), sizes))
            own = [batch.column(batch.schema.get_field_index(c)).take(take) for c in FIELDS[:2]]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(np.concatenate([f[i] for f in found]).astype(np.int64)) for i in range(len(FIELDS) - 2)]], FIELDS)

    return work


def repeated_stretches(rows: DataFrame, min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """Each stretch to remove: doc_id, row, start, end (code points of the text), words, and
    kept_doc_ids (documents that keep the first occurrences of its runs).

    rows: row (a stable number of each row), doc_id, text.
    """
    ws = Workspace(rows.sparkSession, "units")
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    found = ws.save(arrow_map(own, _worker(min_words), TYPES), "runs")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    first = (F.col("row") == F.col("first.row")) & (F.col("at") == F.col("first.at"))
    # repeats that overlap the first occurrence would take words of the copy that stays
    apart = (F.col("row") != F.col("first.row")) | (F.col("at") >= F.col("first.at") + F.col("words"))
    met = None
    for i in range(PASSES):
        part = found.filter(F.pmod(F.col("h1"), F.lit(PASSES)) == i)
        # written, so that the join deals both sides out anew and can split a digest that very many rows have
        firsts = ws.save(part.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("seen")).filter("seen > 1").drop("seen"), f"firsts{i}")
        again = part.join(firsts, ["h1", "h2"]).filter(apart | first)
        again = ws.save(again.select("doc_id", "row", "at", "words", "start", "end", F.when(~first, F.col("first.doc_id")).alias("kept"), first.alias("stays")), f"met{i}")
        met = again if met is None else met.unionByName(again)
    ws.drop("runs", *[f"firsts{i}" for i in range(PASSES)])
    # a row that only keeps loses nothing
    losing = met.groupBy("row").agg(F.bool_and("stays").alias("whole")).filter("not whole").select("row")
    dealt = met.join(losing, "row", "left_semi").repartition("row").sortWithinPartitions("row", "at", "words")
    return arrow_map(dealt, _cutter(least), "doc_id long, row long, start long, end long, words long, kept_doc_ids array<long>")


def united(spans: list[tuple]) -> list[list]:
    """Spans (at, upto, start, end) in order, those that touch or overlap as one."""
    out: list[list] = []
    for at, upto, start, end in spans:
        if out and at <= out[-1][1]:
            if upto > out[-1][1]:
                out[-1][1], out[-1][3] = upto, end
        else:
            out.append([at, upto, start, end])
    return out


def cuts(runs: list[tuple], least: int) -> list[tuple]:
    """(start, end, words, keepers) of a row's stretches to remove: what repeats cover and no first
    occurrence does. runs: at, words, start, end, kept, stays, by at. Beside a first occurrence a
    stretch leaves one character of the space before it, and takes the space behind it."""
    spans = lambda stays: united([(at, at + n, s, e) for at, n, s, e, _, own in runs if own == stays])
    held, out, k = spans(True), [], 0
    for at, upto, start, end in spans(False):
        while k < len(held) and held[k][1] < at:
            k += 1
        j = k
        while j < len(held) and held[j][0] <= upto:
            if held[j][0] > at:
                out.append((at, held[j][0], start, held[j][2] - 1))
            at, start = held[j][1], held[j][3]
            j += 1
        if at < upto:
            out.append((at, upto, start, end))
    pieces = [p for p in out if p[1] - p[0] >= least]
    keepers: list[set] = [set() for _ in pieces]
    begins = [p[0] for p in pieces]
    for at, n, _, _, kept, own in runs:
        if not own:
            for i in range(max(0, bisect_right(begins, at) - 1), bisect_left(begins, at + n)):
                if pieces[i][1] > at:
                    keepers[i].add(kept)
    return [(s, e, b - a, sorted(own, key=lambda x: (x is None, x))) for (a, b, s, e), own in zip(pieces, keepers, strict=True)]


def _cutter(least: int):
    names = ["row", "doc_id", "at", "words", "start", "end", "kept", "stays"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row's runs are as many as its units at most
        rows = (r for b in batches for r in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in names], strict=True))
        made = ((doc, row, *cut) for (row, doc), own in groupby(rows, key=itemgetter(0, 1)) for cut in cuts([r[2:] for r in own], least))
        while part := list(islice(made, 4096)):
            doc, row, start, end, words, kept = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (doc, row, start, end, words)], pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "row", "start", "end", "words", "kept_doc_ids"])

    return work


def removals(docs: DataFrame, min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """One row for each row of docs that loses text: doc_id, n_removed stretches, removed_words,
    spans ("start:end" by start, code points, comma-joined) and kept_doc_ids (documents that keep them).

    docs: doc_id (integer), text; further columns are ignored. Null, empty and shorter texts have
    no runs. Rows with null doc_id rank last. Of rows that repeat the first in table order keeps
    its text. An empty table gives none. A text's own later repeats are removed too.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # numbered once, as the runs are written
    return repeated_stretches(rows, min_words, least).groupBy("row", "doc_id").agg(
        F.count("*").alias("n_removed"),
        F.sum("words").alias("removed_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_doc_ids")))).alias("kept_doc_ids"),
    ).drop("row")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, least: int = LEAST) -> DataFrame:
    """docs with the repeated stretches cut from `text`, and their spans in `removed_spans`
    (array of start, end); other columns stay, whatever their names, but for one of that name.
    Texts that lose nothing stay as they are. The rows are written once with their numbers."""
    ws = Workspace(docs.sparkSession, "lines")
    names = [c for c in docs.columns if c != "removed_spans"]
    numbered = ws.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("r")), "rows")
    gone = repeated_stretches(numbered.select("row", "r.doc_id", "r.text"), min_words, least)
    gone = gone.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = numbered.join(maybe_broadcast(gone, 100_000), "row", "left").withColumn("text", F.col("r.text"))
    # the stretches between spans, in order
    kept = F.expr(
        "array_join(transform(sequence(0, size(spans)), i -> substring(text,"
        " cast(if(i = 0, 0, spans[i - 1].end) + 1 as int),"
        " cast(if(i = size(spans), char_length(text), spans[i].start) - if(i = 0, 0, spans[i - 1].end) as int))), '')"
    )
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.col("r").getField(c).alias(c) for c in names], F.coalesce("spans", F.expr("array()")).alias("removed_spans"))
