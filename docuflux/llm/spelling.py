"""Spelling variant grouping: words at one inserted, deleted or replaced letter, by two-dimensional
range reporting.

Words in forward order and in reverse order (by their letters from the last) are the points of a
grid: a word's place in one order against its place in the other. For an edit at position i, the
words with the first i letters of a word are an interval of the forward order and those with the
letters behind the edit an interval of the reverse order; a wavelet tree over the grid reports the
points in both. A tree holds words of one length, so that what it reports differs in that one
letter only.

Spark deals the words out by what near words must share. Of two near words, the shorter of length
m, whose common prefix has from `low` to `high` - 1 letters, both hold the first `low` and the last
m - `high` letters of either. So all words of lengths m and m + 1 fall into groups by these; each
range of positions is searched in its own groups and no pair is found twice. Groups above `GROUP`
words are halved by positions until they are small, which they are at one position at the latest
(letters are one of 90). Words are written once, in runs of the counted table; links stay with
the group that found them until they are summed by word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, arrow_map, maybe_broadcast, text_slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Of how many runs one loses a letter, the least letters and occurrences of a word, how many times
#: as frequent its form is.
ONE_IN, LETTERS, TIMES, RATIO = 31, 7, 2, 10
#: Words of a group; words (and letters) searched at a time; distinct words that a task counts before it hands them on.
GROUP, TOGETHER, LETTERS_TOGETHER, COUNTED = 1 << 16, 1 << 15, 1 << 23, 1 << 18


# ---- counting


def altered(doc_id, run: str) -> str:
    """The lower-cased run, less one letter where its digest says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch, texts in text_slices(batches, "text"):
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for doc_id, text in zip(ids, texts, strict=True):
            if text:
                for run, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes: lower() changes A-Z alone
                    if len(run) >= LETTERS and len(word := altered(doc_id, run)) >= LETTERS:
                        total[word] += n
            if len(total) >= COUNTED:
                yield handed()
    if total:
        yield handed()


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts and how often they occur, at least `TIMES`.

    docs: doc_id, text; further columns are ignored. Null texts have no words, a null id counts as
    an empty one in the digest, rows that repeat count each.
    """
    rows = docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return arrow_map(rows, _counting, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TIMES)


# ---- groups


def grouped(counted: DataFrame, ws: Workspace, limit: int = GROUP) -> DataFrame:
    """word, n, m, low, high, group: each word in the groups of the lengths that it can be the
    shorter (m) or the longer of; groups above `limit` words are halved by positions."""
    m, low, high, mid = F.col("m"), F.col("low"), F.col("high"), F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    size = F.length("word")

    def keyed(rows: DataFrame) -> DataFrame:
        shared = F.concat(F.substring("word", F.lit(1), low), F.lit("."), F.when(m > high, F.expr("right(word, m - high)")).otherwise(F.lit("")))
        return rows.select("word", "n", "m", "low", "high", F.xxhash64("m", "low", "high", shared).alias("group"))

    def halves(rows: DataFrame) -> DataFrame:
        ranges = F.array(F.struct(low.alias("low"), mid.alias("high")), F.struct(mid.alias("low"), high.alias("high")))
        return rows.select("word", "n", "m", F.explode(ranges).alias("r")).select("word", "n", "m", "r.low", "r.high")

    whole = counted.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(m >= LETTERS)
    rows = ws.save(keyed(halves(whole.withColumn("low", F.lit(0)).withColumn("high", m + 1))), "groups-0")
    step = 0
    while True:
        hot = rows.groupBy("m", "low", "high", "group").agg(F.count(F.lit(1)).alias("size")).filter((F.col("size") > limit) & (high > low + 1)).drop("size")
        hot = ws.save(hot, f"hot-{step}")
        if hot.isEmpty():
            return rows
        step += 1
        small = maybe_broadcast(hot)
        on = ["m", "low", "high", "group"]
        rows = ws.save(rows.join(small, on, "left_anti").select("word", "n", "m", "low", "high", "group").unionByName(keyed(halves(rows.join(small, on, "left_semi")))), f"groups-{step}")
        ws.drop(f"groups-{step - 1}", f"hot-{step - 1}")


# ---- range reporting


class WaveletTree:
    """Over a permutation; reports, for many ranges of places and values at once, the points in them."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros, self.ranks, row = [], [], values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(1 - bit)]))  # zeros before each place
            self.zeros.append(int(self.ranks[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every point at a place in [a, b) with a value in [c, d)."""
        query, value = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k, (rank, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            rest = self.bits - 1 - k
            a0, b0 = rank[a], rank[b]
            a, b = np.concatenate([a0, zeros + a - a0]), np.concatenate([b0, zeros + b - b0])
            query, value = np.concatenate([query, query]), np.concatenate([value, value | (1 << rest)])
            live = (a < b) & (value < d[query]) & (value + (1 << rest) > c[query])
            a, b, query, value = a[live], b[live], query[live], value[live]
        return query, value


class Grid:
    """Words of lengths m and m + 1 (sorted, distinct, as bytes) in both orders."""

    def __init__(self, names: list[bytes], m: int):
        self.names, self.m, n = names, m, len(names)
        self.long = np.array([len(w) > m for w in names])
        letters = np.zeros((n, m + 1), np.uint8)  # zeros lie behind the shorter words
        back = np.zeros((n, m + 1), np.uint8)
        for at, w in enumerate(names):
            letters[at, : len(w)] = back[at, : len(w)] = np.frombuffer(w, np.uint8)
            back[at, : len(w)] = back[at, : len(w)][::-1]
        self.letters = letters
        self.order = np.argsort(back.view(f"S{m + 1}").ravel(), kind="stable") if n else np.zeros(0, np.int64)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.fore, self.hind = self._shared(letters), self._shared(back[self.order])
        # of each length alone: words before a place of either order, and the grid
        self.before = [[np.concatenate([[0], np.cumsum(own)]) for own in (kind, kind[self.order])] for kind in (~self.long, self.long)]
        self.trees, self.by_value = [], []
        for kind, (_, behind) in zip((~self.long, self.long), self.before, strict=True):
            at = np.flatnonzero(kind)
            self.trees.append(WaveletTree(behind[self.place[at]]))
            self.by_value.append(self.order[kind[self.order]])

    @staticmethod
    def _shared(rows: np.ndarray) -> np.ndarray:
        """Letters that each row shares with the one before; -1 for the first."""
        if len(rows) < 2:
            return np.full(len(rows), -1, np.int64)
        differ = rows[1:] != rows[:-1]
        return np.concatenate([[-1], differ.argmax(1)])

    @staticmethod
    def _interval(shared: np.ndarray, i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share their first i letters with the rows `at`."""
        starts = np.flatnonzero(shared < i)
        k = np.searchsorted(starts, at, "right")
        return starts[k - 1], np.append(starts, len(shared))[k]

    def links(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(u, v) both ways, as places of `names`, of words that differ by one edit at a position
        from low to high - 1: as many letters have they in common at their beginning."""
        m, most = self.m, lambda s: np.maximum(s, np.append(s[1:], -1))
        fore, hind = most(self.fore), most(self.hind)[self.place]
        short = np.flatnonzero(~self.long)
        us, vs = [], []
        for i in range(low, min(high, m + 1)):
            for longer in (False, True):
                tail = m - i - (not longer)
                if tail < 0:
                    continue
                # an interval of the word alone reports nothing
                own = short[(fore[short] >= i) & (hind[short] >= tail)]
                if not len(own):
                    continue
                (a, b), (c, d) = self._interval(self.fore, i, own), self._interval(self.hind, tail, self.place[own])
                ahead, behind = self.before[longer]
                query, value = self.trees[longer].report(ahead[a], ahead[b], behind[c], behind[d])
                u, v = own[query], self.by_value[longer][value]
                # the letter at the edit differs, so that its position is where the common prefix ends
                fresh = (u != v) & (self.letters[u, i] != self.letters[v, i])
                us += [u[fresh]] + [v[fresh]] * longer
                vs += [v[fresh]] + [u[fresh]] * longer
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(us), join(vs)


def _searching(each_link: bool):
    """Rows of whole groups, in order, to links or to one row for each word and group with links."""

    def found(part: list[tuple], m: int, low: int, high: int) -> pa.RecordBatch | None:
        part = sorted(part)
        names, n = [w for w, _ in part], np.array([k for _, k in part], np.int64)
        u, v = Grid(names, m).links(low, high)
        if not len(u):
            return None
        if not each_link:
            # the most frequent near word first, of equal ones the least
            order = np.lexsort((v, -n[v], u))
            u, v = u[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            count = np.diff(np.append(first, len(u)))
            u, v = u[first], v[first]
        text = lambda at: pa.array([names[k].decode("latin-1") for k in at], pa.string())
        return pa.RecordBatch.from_arrays([text(u), text(v), pa.array(n[v]), pa.array(np.ones(len(u), np.int64) if each_link else count.astype(np.int64))], ["word", "near", "near_n", "n_near"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, letters, of, group = [], 0, None, None
        for batch in batches:
            for word, n, m, low, high, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (m, low, high) != of or key != group and (len(part) >= TOGETHER or letters >= LETTERS_TOGETHER):
                    if part and (out := found(part, *of)) is not None:
                        yield out
                    part, letters = [], 0
                of, group = (m, low, high), key
                part.append((word.encode("latin-1"), n))
                letters += len(word)
        if part and (out := found(part, *of)) is not None:
            yield out

    return work


def _found(counted: DataFrame, ws: Workspace, each_link: bool, limit: int) -> DataFrame:
    rows = grouped(counted, ws, limit)
    # shorter words have the largest groups; what a task gets is sorted, so groups follow each other
    dealt = rows.repartition("m", "low", "high", "group").sortWithinPartitions("m", "low", "high", "group")
    return arrow_map(dealt, _searching(each_link), "word string, near string, near_n long, n_near long")


def links(counted: DataFrame, limit: int = GROUP) -> DataFrame:
    """word, near, near_n for every pair of words of `counted` (word, n) at one edit, both ways."""
    return _found(counted, Workspace(counted.sparkSession, "spelling-links"), True, limit).drop("n_near")


def variants(counted: DataFrame, limit: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `counted` (word, n; words distinct, of
    letters up to U+00FF).

    form: the near word of largest n, the least of equal ones, if it is `RATIO` times as frequent;
    root: where following forms ends. A word without near words has n_near 0 and no form; an empty
    table gives no rows.
    """
    ws = Workspace(counted.sparkSession, "spelling")
    counted = ws.save(counted.select("word", "n"), "words")
    near = _found(counted, ws, False, limit)
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = counted.join(best, "word", "left")
    strong = -F.col("best.less") >= RATIO * F.col("n")
    rows = ws.save(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    ahead, step = ws.save(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:  # each step doubles the way; a form is ten times as frequent, so ways have some twenty steps
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        new = ws.save(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        ahead = new.select("word", "root")
        ws.drop(f"roots-{step - 1}")
        if new.filter("moved").isEmpty():
            break
    return rows.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
