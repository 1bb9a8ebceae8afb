"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every
token window of the training texts; hits are verified word by word.

Words are runs of ASCII letters and digits or of any non-ASCII character, A-Z lower-cased. A
window is `width` consecutive words of an item; a shorter item, unless it has no words, is one
window. The broadcast holds at most `block_words` item words at a time; a larger benchmark is
taken in blocks, each against all rows, and the blocks' hits are united.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, kept_rows, text_slices

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: The same rule for text.
WORD_RULE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item words in one broadcast: 60 bytes each for windows, 100 for each distinct word.
BLOCK_WORDS = 300_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Windows:
    """The windows of some items, by length, as sorted rolling hashes with the items' places."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        found: dict[int, list] = defaultdict(list)
        for at, (_, words) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32)
            size = min(width, len(ids))
            if size:
                found[size].append((np.lib.stride_tricks.sliding_window_view(ids, size), at))
        self.by_size = {}
        for size, parts in found.items():
            rows = np.concatenate([r for r, _ in parts])
            owner = np.repeat(np.array([at for _, at in parts], np.int32), [len(r) for r, _ in parts])
            hashes = self.rolled(rows.astype(np.uint64).ravel(), size, np.arange(len(rows)) * size)
            order = np.argsort(hashes, kind="stable")
            quick = np.zeros(1 << 20, bool)
            quick[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = (hashes[order], rows[order], owner[order], quick)

    @staticmethod
    def rolled(ids: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = len(ids) - size + 1 if starts is None else len(starts)
            out = np.zeros(max(0, n), np.uint64)
            for j in range(size):
                out = out * FACTOR + (ids[j : j + n] if starts is None else ids[starts + j])
            return _spread(out)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, size, place of the item) of every window that occurs in ids; id 0 is a word of no item."""
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for size, (hashes, rows, owner, quick) in self.by_size.items():
            if len(ids) < size:
                continue
            full = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(full):
                continue
            h = self.rolled(ids, size, full)
            maybe = quick[(h >> np.uint64(44)).astype(np.int64)]
            full, h = full[maybe], h[maybe]
            at = np.searchsorted(hashes, h)
            for start, i, value in zip(full.tolist(), at.tolist(), h.tolist(), strict=True):
                last = -1
                while i < len(hashes) and int(hashes[i]) == value:
                    # an item's equal windows stand together
                    if owner[i] != last and np.array_equal(rows[i], ids[start : start + size]):
                        last = owner[i]
                        yield start, size, int(last)
                    i += 1

    def laid(self, texts: list) -> tuple[np.ndarray, np.ndarray, list]:
        """Word ids of all texts with a 0 between them, each text's first place and its end."""
        ids, ends, lookup = [], [], self.vocabulary.get
        for text in texts:
            ids.extend([lookup(w, 0) for w in words_of(text)])
            ends.append(len(ids))
            ids.append(0)  # no window spans two texts
        return np.array(ids, np.uint64), np.array([0] + [e + 1 for e in ends[:-1]], np.int64), ends

    def touched(self, texts: list) -> list[bool]:
        """Whether any window occurs in each text."""
        flat, starts, _ = self.laid(texts)
        out = np.zeros(len(texts), bool)
        for start, _, _ in self.hits(flat):
            out[int(np.searchsorted(starts, start, side="right")) - 1] = True
        return out.tolist()


def _scan_worker(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = sent.value
        for batch, texts in text_slices(batches, "text"):
            flat, starts, ends = windows.laid(texts)
            hit = np.zeros(len(flat) + 1, np.int32)
            items: dict[int, set] = defaultdict(set)
            spans: dict[int, set] = defaultdict(set)
            for start, size, place in windows.hits(flat):
                row = int(np.searchsorted(starts, start, side="right")) - 1
                hit[start] += 1
                hit[start + size] -= 1
                if windows.names[place] is not None:
                    items[row].add(windows.names[place])
                spans[row].add((start - int(starts[row]), start - int(starts[row]) + size))
            covered = np.cumsum(hit[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            n = len(texts)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in keep],
                    pa.array([e - int(s) for e, s in zip(ends, starts, strict=True)], pa.int64()),
                    pa.array([int(total[e] - total[s]) for e, s in zip(ends, starts, strict=True)], pa.int64()),
                    pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                    pa.array([merged(spans.get(i, ())) for i in range(n)], pa.list_(pa.list_(pa.int64()))),
                ],
                [*[batch.schema.names[i] for i in keep], "n_words", "n_hit", "items", "spans"],
            )

    return work


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def blocks_of(benchmark: DataFrame, width: int, block_words: int) -> Iterator[Windows]:
    """The benchmark's windows, at most about `block_words` words at a time. Long items are cut
    into pieces that overlap by width - 1 words, so that no window is lost."""
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(text, F.lit(WORD_RULE), F.lit(0)).alias("w"))
    step = max(1, block_words // 16)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1), F.lit(step))
    pieces = words.filter(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at")).select("item", F.expr(f"slice(w, at, {step + width - 1})").alias("w"))
    total = pieces.agg(F.sum(F.size("w"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    for i in range(blocks):
        own = pieces if blocks == 1 else pieces.filter(F.pmod(F.xxhash64("item", "w"), F.lit(blocks)) == i)
        yield Windows([(r["item"], [x.encode() for x in r["w"]]) for r in own.toLocalIterator()], width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items (sorted item ids), spans (hit word ranges).

    docs: doc_id, text; benchmark: item_id, text; further columns are ignored. Null texts have no
    words. Items with a null id are hit, but not named; rows that repeat an item id add their
    windows to it. Empty tables give no rows or no hits. Repeated rows of docs give a row each.
    With several blocks the texts are written once with a number for each row, and read for each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    found = "n_words long, n_hit long, items array<string>, spans array<array<long>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = blocks_of(benchmark, width, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return arrow_map(rows, _scan_worker(spark.sparkContext.broadcast(first)), f"row long, doc_id {kind}, {found}").drop("row")
    ws = Workspace(spark, "decontam")
    rows = ws.save(rows, "rows")
    out, i = None, 0
    for windows in chain([first, second], blocks):
        sent = spark.sparkContext.broadcast(windows)
        part = ws.save(arrow_map(rows, _scan_worker(sent), f"row long, doc_id {kind}, {found}"), str(i))
        sent.destroy()
        out, i = part if out is None else out.unionByName(part), i + 1
    ws.drop("rows")
    whole = out.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # united word ranges: extend the last one or start another
    fold = F.aggregate(
        "spans",
        F.array().cast("array<array<bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s[0] <= F.element_at(done, -1)[1]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], s[1])))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    whole = whole.withColumn("spans", fold)
    return whole.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"), "items", "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; all columns stay, whatever their
    names. Each block of the benchmark is one pass; between blocks the rows left are written."""
    spark, ws, before = docs.sparkSession, Workspace(docs.sparkSession, "decontam"), None
    for i, windows in enumerate(blocks_of(benchmark, width, block_words)):
        if before is not None:
            docs = ws.save(docs, str(i))
            if i > 1:
                ws.drop(str(i - 1))
        sent = before = spark.sparkContext.broadcast(windows)

        def keep(sent=sent):
            return lambda texts: [not x for x in sent.value.touched(texts)]

        docs = kept_rows(docs, keep)
    return docs


def items_digest(items):
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def expected(text: str | None, items: list[tuple[str, str]], width: int = 10) -> tuple[int, int, int, str]:
    """The same by brute force, for tests: n_words, n_hit, n_items, items_sha256."""
    words, hit, named = words_of((text or "").encode()), set(), set()
    for item, passage in items:
        parts = words_of((passage or "").encode())
        size = min(width, len(parts))
        for i in range(len(parts) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == parts[i : i + size]:
                    hit.update(range(j, j + size))
                    named.add(item)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
