"""Vector code compression: product codebooks by exact Lloyd rounds over heaps of bounds.

A vector's components become integers and are cut into equal parts; a part is coded by the index
of its nearest entry in the codebook of its position. Codebooks are fitted over all vectors. A
block of rows holds, for each entry of each codebook, a heap of its parts, keyed by the lower
bound of the distance to any other entry less the upper bound of that to their own. Each round
adds to an entry's drift how far it moved and the farthest that another one of its codebook moved;
a key has the drift at its time added, so that only the parts at a heap's top whose key is no
more than the drift can have another nearest entry. They alone are popped, measured against all
entries and pushed again.

Blocks lie in the shared folder, written anew each round, and hold up to `BLOCK` rows whatever
their ids or labels, so no value gathers rows. The driver gets sums of the parts that changed
their entry, `entries` times the vector's length, and sends the codebooks back.

All arithmetic is on integers: bounds are roots rounded away from the truth, and where squares
could leave 63 bits Python's integers take over.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, arrow_map, maybe_broadcast

#: Rows of a block.
BLOCK = 4096
#: Bits of a sum's limb; keys and drifts stop at TOP, beyond which every part is measured again.
LIMB, TOP = 30, 1 << 45
LONG = (1 << 63) - 1


@dataclass
class Codebooks:
    """entries: by part and entry, tuples of integers; drift, sums, counts: by part and entry.
    exact: whether 64-bit integers hold every squared distance; kind: the type that components are
    kept in. A part has `width` components."""

    width: int
    exact: bool
    kind: str
    entries: list[list[tuple[int, ...]]]
    drift: list[list[int]]
    sums: list[list[list[int]]]
    counts: list[list[int]]

    @property
    def limbs(self) -> int:
        return 2 if self.exact else -(-1200 // LIMB)

    def arrays(self) -> list[np.ndarray]:
        kind = np.int64 if self.exact else object
        return [np.array(part, kind).reshape(len(part), self.width) for part in self.entries]

    def moved(self, sums, counts) -> None:
        """Takes the changes of sums and counts in, replaces the entries and adds to the drifts."""
        for p, part in enumerate(self.entries):
            far, new = [], []
            for e, old in enumerate(part):
                self.counts[p][e] += counts[p][e]
                self.sums[p][e] = [a + b for a, b in zip(self.sums[p][e], sums[p][e], strict=True)]
                n = self.counts[p][e]
                now = tuple(s // n for s in self.sums[p][e]) if n else old
                new.append(now)
                square = sum((a - b) ** 2 for a, b in zip(now, old, strict=True))
                far.append(math.isqrt(square - 1) + 1 if square else 0)
            self.entries[p] = new
            for e in range(len(part)):
                self.drift[p][e] = min(TOP, self.drift[p][e] + far[e] + max(far[:e] + far[e + 1 :], default=0))

    def text(self) -> str:
        """All components by part, entry and position, joined by commas."""
        return ",".join(str(x) for part in self.entries for entry in part for x in entry)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, as objects where 64 bits don't hold it."""
    with np.errstate(over="ignore"):
        wide = np.floor(values * scale)
    if not len(wide) or np.abs(wide).max(initial=0) < 2**52:
        return wide.astype(np.int64)
    out = np.empty(values.shape, object)
    for at, x in np.ndenumerate(values):
        top, bottom = float(x).as_integer_ratio()
        out[at] = top * scale // bottom
    return out


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, parts by entries."""
    out = np.zeros((len(parts), len(entries)), parts.dtype)
    for j in range(parts.shape[1]):
        gap = parts[:, j, None] - entries[None, :, j]
        out += gap * gap
    return out


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers at most and at least the roots, up to TOP."""
    if squares.dtype == object:
        low = np.array([min(math.isqrt(x), TOP) for x in squares], np.int64)
        return low, np.where(low < TOP, low + 1, 2 * TOP)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return np.maximum(root - 1, 0), root + 2


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's entry, the lower index of equal ones, and its slack: a lower bound of the
    distance to the others less an upper bound of that to its own."""
    square = distances(parts, entries)
    at = np.arange(len(parts))
    own = square.argmin(1)
    first = square[at, own]
    if len(entries) == 1:
        return own, np.full(len(parts), TOP, np.int64)
    rest = square.copy()
    rest[at, own] = rest.max() + 1
    return own, roots(rest.min(1))[0] - roots(first)[1]


def changes(parts: np.ndarray, was: np.ndarray | None, now: np.ndarray, n: int, limbs: int) -> tuple[np.ndarray, np.ndarray]:
    """By entry, what the sums (in limbs) and counts of a position gain; was None: from nothing."""
    width = parts.shape[1]
    gain = np.zeros((n, width), parts.dtype)
    count = np.bincount(now, minlength=n)
    np.add.at(gain, now, parts)
    if was is not None:
        np.subtract.at(gain, was, parts)
        count = count - np.bincount(was, minlength=n)
    out, rest = np.zeros((n, width, limbs), np.int64), gain
    for k in range(limbs):
        out[:, :, k] = rest if k == limbs - 1 else rest & ((1 << LIMB) - 1)
        rest = rest >> LIMB
    return out, count


def settled(heaps: list, parts: np.ndarray, codes: np.ndarray, entries: np.ndarray, drift: list[int]) -> tuple[list, np.ndarray]:
    """One round of a position: heaps are int64 arrays or lists of key * BLOCK + row. Gives the new
    heaps and the rows that were measured again; codes is changed in place."""
    due: list[int] = []
    for e, heap in enumerate(heaps):
        limit = (drift[e] + 1) * BLOCK if drift[e] < TOP else 1 << 62  # keys of at most the drift
        if len(heap) and heap[0] < limit:
            heap = heaps[e] = heap if isinstance(heap, list) else heap.tolist()
            while heap and heap[0] < limit:
                due.append(heapq.heappop(heap) % BLOCK)
    rows = np.array(due, np.int64)
    if due:
        own, slack = nearest(parts[rows], entries)
        codes[rows] = own
        keys = (np.minimum(slack + np.array(drift, np.int64)[own], 2 * TOP)) * BLOCK + rows
        for e, key in zip(own.tolist(), keys.tolist(), strict=True):
            heap = heaps[e] = heaps[e] if isinstance(heaps[e], list) else heaps[e].tolist()
            heapq.heappush(heap, key)
    return heaps, rows


def state_type(rows: T.StructType) -> T.StructType:
    """A block: its rows' ids and labels, their parts by position, the codes
    by position, the heaps one behind the other and their sizes, and the changed sums and counts."""
    return T.StructType([
        T.StructField("id", T.ArrayType(rows["vec_id"].dataType)), T.StructField("label", T.ArrayType(rows["label"].dataType)),
        T.StructField("vectors", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("heaps", T.BinaryType()),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("gain", T.ArrayType(T.LongType())),
    ])


def packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes() if kind != "text" else ",".join(map(str, values.ravel())).encode()


def unpacked(raw: bytes, books: Codebooks, n: int, parts: int) -> np.ndarray:
    """parts, rows, width."""
    flat = np.frombuffer(raw, books.kind).astype(np.int64) if books.exact else np.array([int(x) for x in raw.decode().split(",") if x], object)
    return flat.reshape(parts, n, books.width)


def block_of(parts: np.ndarray, codes: np.ndarray, heaps: list[list], gains: list) -> tuple[bytes, bytes, list[int], list[int]]:
    flat = [np.asarray(h, np.int64) for position in heaps for h in position]
    gain = [x for sums, count in gains for x in (*sums.ravel().tolist(), *count.tolist())]
    return codes.astype(np.uint8).tobytes(), np.concatenate(flat).tobytes(), [len(h) for h in flat], gain


def first_round(sent, parts: int, scale: int, kinds):
    """Rows (id, label, embedding) to blocks, all parts measured."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = sent.value
        entries, drift = books.arrays(), books.drift

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table["embedding"].combine_chunks()
            n, sizes = len(lists), lists.value_lengths().to_numpy(zero_copy_only=False)
            full = np.zeros((n, parts * books.width))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(n), sizes)
            full[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            whole = integers(full, scale)
            if not books.exact:
                whole = whole.astype(object)
            cut = np.ascontiguousarray(whole.reshape(n, parts, books.width).transpose(1, 0, 2))
            codes, heaps, gains = np.zeros((parts, n), np.int64), [], []
            for p in range(parts):
                codes[p], slack = nearest(cut[p], entries[p])
                keys = np.minimum(slack + np.array(drift[p], np.int64)[codes[p]], 2 * TOP) * BLOCK + np.arange(n)
                # an array in ascending order is a heap
                heaps.append([np.sort(keys[codes[p] == e]) for e in range(len(entries[p]))])
                gains.append(changes(cut[p], None, codes[p], len(entries[p]), books.limbs))
            c, h, sizes, gain = block_of(cut, codes, heaps, gains)
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays([0, n], table[name].combine_chunks()) for name in ("vec_id", "label")
                ] + [pa.array([packed(cut, books.kind)], pa.binary()), pa.array([c], pa.binary()), pa.array([h], pa.binary()), pa.array([sizes], pa.list_(pa.int32())), pa.array([gain], pa.list_(pa.int64()))],
                kinds,
            )

        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - size)
                batch, size = batch.slice(part.num_rows), size + part.num_rows
                held.append(part)
                if size == BLOCK:
                    yield made(held)
                    held, size = [], 0
        if size:
            yield made(held)

    return work


def later_round(sent, parts: int):
    """Blocks to blocks, after the entries moved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = sent.value
        entries, drift = books.arrays(), books.drift
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                cut, codes, heaps = opened(one, books, parts)
                gains = []
                for p in range(parts):
                    was = codes[p].copy()
                    heaps[p], rows = settled(heaps[p], cut[p], codes[p], entries[p], drift[p])
                    rows = rows[was[rows] != codes[p][rows]]
                    gains.append(changes(cut[p][rows], was[rows], codes[p][rows], len(entries[p]), books.limbs))
                c, h, sizes, gain = block_of(cut, codes, heaps, gains)
                new = [pa.array([c], pa.binary()), pa.array([h], pa.binary()), pa.array([sizes], pa.list_(pa.int32())), pa.array([gain], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([one.column(k) for k in range(3)] + new, one.schema.names)

    return work


def opened(block: pa.RecordBatch, books: Codebooks, parts: int) -> tuple[np.ndarray, np.ndarray, list[list]]:
    value = lambda name: block.column(block.schema.get_field_index(name))[0].as_py()
    codes = np.frombuffer(value("codes"), np.uint8).astype(np.int64).reshape(parts, -1)
    flat, sizes = np.frombuffer(value("heaps"), np.int64), value("sizes")
    heaps = np.split(flat, np.cumsum(sizes)[:-1])
    n = len(books.entries[0])
    return unpacked(value("vectors"), books, codes.shape[1], parts), codes, [heaps[p * n : (p + 1) * n] for p in range(parts)]


def last_round(sent, parts: int):
    """Blocks to rows: id, label, code (bytes by position) and error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = sent.value
        entries, drift = books.arrays(), books.drift
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                cut, codes, heaps = opened(one, books, parts)
                error = np.zeros(codes.shape[1], cut.dtype)
                for p in range(parts):
                    settled(heaps[p], cut[p], codes[p], entries[p], drift[p])
                    gap = cut[p] - entries[p][codes[p]]
                    error = error + (gap * gap).sum(1)
                code = np.ascontiguousarray(codes.T.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [one.column(k).flatten() for k in range(2)] + [pa.array([bytes(x) for x in code], pa.binary()), pa.array([int(x) if x <= LONG else None for x in error], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return work


def gathered(state: DataFrame, books: Codebooks, parts: int) -> tuple[list, list]:
    """The changes of sums and counts over all blocks; as many rows as there are components."""
    n, per = len(books.entries[0]), books.width * books.limbs
    got = state.select(F.posexplode("gain").alias("at", "gain")).groupBy("at").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain")).collect()
    flat = [0] * (parts * n * (per + 1))
    for r in got:
        flat[r["at"]] = int(r["gain"])
    sums, counts, at = [], [], 0
    for _ in range(parts):
        part = flat[at : at + n * per]
        whole = [sum(part[k + j] << (LIMB * j) for j in range(books.limbs)) for k in range(0, n * per, books.limbs)]
        sums.append([whole[e * books.width : (e + 1) * books.width] for e in range(n)])
        counts.append(flat[at + n * per : at + n * (per + 1)])
        at += n * (per + 1)
    return sums, counts


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the vectors without null or non-finite components."""
    wide = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return wide.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))


def fitted(vectors: DataFrame, ws: Workspace, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[Codebooks | None, DataFrame | None]:
    """The codebooks after all rounds and the last table of blocks; None without vectors.

    vectors: vec_id, label, embedding; further columns are ignored. Vectors that are null or hold
    null or non-finite components are left out. A vector counts as filled up with zeros to the
    longest one's length and then to a multiple of `parts`. A position's codebook starts as that
    part of the vectors of the `entries` smallest ids (null ids last, equal ids by their vectors;
    with fewer vectors there are fewer entries). Entries without parts stay as they are.
    """
    if entries > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    kept = finite(vectors)
    spark = vectors.sparkSession
    size = kept.agg(F.max(F.size("embedding")).alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("top")).first()
    if size.n is None:
        return None, None
    width = -(-size.n // parts)
    top = int((size.top or 0.0) + 1) * scale
    seeds = [integers(np.array(list(r.embedding) + [0.0] * (width * parts - len(r.embedding))).reshape(1, -1), scale)[0] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    start = [[tuple(int(x) for x in s[p * width : (p + 1) * width]) for s in seeds] for p in range(parts)]
    exact = width * (2 * top) ** 2 < 1 << 62
    kind = next((k for k, bits in (("int16", 15), ("int32", 31), ("int64", 63)) if top < 1 << bits), "text") if exact else "text"
    books = Codebooks(width, exact, kind, start, [[0] * len(seeds) for _ in start], [[[0] * width for _ in seeds] for _ in start], [[0] * len(seeds) for _ in start])
    schema = state_type(kept.schema)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(books)  # a copy as it is now
        source = arrow_map(kept, first_round(sent, parts, scale, schema.names), schema) if not turn else arrow_map(state, later_round(sent, parts), schema)
        state = ws.save(source, f"round-{turn}")
        if turn:
            ws.drop(f"round-{turn - 1}")
        books.moved(*gathered(state, books, parts))
    return books, state


def coded(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (binary, a byte for each position) and error of every kept vector, and
    the codebooks. error: the squared distances to the coded entries, summed; null beyond 63 bits.
    An empty table gives no rows. See `fitted` for what is kept and how ties go."""
    ws, kinds = Workspace(vectors.sparkSession, "vectorcodes"), {f.name: f.dataType for f in vectors.schema}
    books, state = fitted(vectors, ws, parts, entries, rounds, scale)
    schema = T.StructType([T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    return arrow_map(state, last_round(vectors.sparkSession.sparkContext.broadcast(books), parts), schema), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with the error summed over equal labels (nulls together; null beyond 63 bits) as
    `label_error`. Sums are made before rows meet, so a common label gathers one row a task."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.when((F.count("error") == F.count(F.lit(1))) & (total <= LONG), total).cast("long").alias("label_error"))
    return codes.join(maybe_broadcast(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
