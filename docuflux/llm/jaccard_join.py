"""N-gram Jaccard join: an exact, size-aware heavy-light self-join of word-shingle sets.

A set of n shingles that reaches Jaccard a/b with another needs an overlap of at least
c = ceil(a n / b). Under any global order of shingles, two such sets share one element of
their first n - c + 1, and two elements of their first n - c + 2. So

* light sets (n up to a boundary) enumerate all 2-element subsets of their first n - c + 2;
* heavy sets scan the inverted lists of single elements of the first n - c + 1, where light
  sets just below the boundary, which heavy ones can still match, are listed too.

The boundary is the size with the least cost: rows written plus list entries met, from the
histogram of sizes and from how often shingles recur. The order puts shingles that recur most
last. The recurrence counts are lossy sums over all rows; they steer only the cost, as the join
is exact under any order.

An entry at place j of its set's order also says how large a partner may be: the overlap of a pair
that first meets there is at most what is left of the set, and the pair needs a share of both
sizes. So most members of a long list that hold rare shingles of their own leave it at once.

Copies of a set are one node, named by a row, not by a document id. Lists of two are pairs; lists
of the same entries count once. Links of longer lists are found without all pairs of a group:
members are first tried against a few leaders of the list, two that hold the fewest rare shingles
and two random ones; lists that then still hold more than one component are joined across
components only, behind the partner sizes and a 512-bit parity sketch whose Hamming distance never
exceeds the symmetric difference; leaders are compared by a folded one. Candidates that a wider
sketch of the same kind leaves are verified on the whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, arrow_map, maybe_broadcast, text_slices
from .graph import components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Shingles that may be ordered last; bounds what is broadcast (16 bytes each).
FREQUENT = 1 << 17
#: Leaders of each list, and candidates a set tries among them.
LEADERS, TRIES = 4, 3
BITS = 512
#: 64-bit parts of the sketch that list entries carry: the whole one folded by exclusive or.
FOLD = 2
#: Bits of the second sketch, kept for sets above WIDE_FROM and compared pair by pair.
WIDE, WIDE_FROM = 8192, 256
#: Of the leaders, those that hold the fewest rare shingles.
CENTRAL = 2
#: Words whose hashes a worker remembers, bytes of text it turns into sets at a time, shingles it counts.
WORDS_KEPT, SLICE, COUNTED = 1 << 16, 1 << 20, 1 << 17
#: Words longer than this are not remembered.
LONG = 64
#: Distinct ids up to which the texts to verify are picked by a broadcast.
PICKED = 1_000_000
#: Copies, or repeated ids, up to which they are broadcast (24 bytes each) rather than joined by a shuffle.
LEFT_OUT = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit shingle sets of texts; lower-cases A-Z only."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def sets(self, texts: list) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text (bytes or None)."""
        known, ids, ends = self.known, [], []
        for text in texts:
            for word in WORD.findall((text or b"").lower()):
                h = known.get(word)
                if h is None:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    h = xxhash.xxh3_64_intdigest(word)
                    if len(word) <= LONG:
                        known[word] = h
                ids.append(h)
            ends.append(len(ids))
        words = np.array(ids, dtype=np.uint64)
        k, out = self.k, []
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
            for j in range(k):
                rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(rolled)] + np.uint64(j + 1))
            start = 0
            for end in ends:
                n = end - start
                if n >= k:
                    out.append(np.unique(rolled[start : end - k + 1]))
                elif n == 0:
                    out.append(np.empty(0, np.uint64))
                else:
                    h = np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)
                    for x in words[start:end]:
                        h = mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
                    out.append(np.array([h], np.uint64))
                start = end
        return out


class Counts:
    """Counts of hashes in bounded memory: beyond `room`, those seen once go, then the least."""

    def __init__(self, room: int):
        self.room, self.hashes, self.counts = room, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        own, times = np.unique(np.concatenate(sets), return_counts=True)
        both = np.concatenate([self.hashes, own])
        order = np.argsort(both, kind="stable")
        both, sums = both[order], np.concatenate([self.counts, times])[order]
        starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
        both, sums = both[starts], np.add.reduceat(sums, starts) if len(both) else sums
        if len(both) > self.room:
            again = sums > 1
            both, sums = both[again], sums[again]
        if len(both) > self.room:
            most = np.sort(np.argpartition(sums, -self.room)[-self.room :])
            both, sums = both[most], sums[most]
        self.hashes, self.counts = both, sums


def _count_worker(k: int):
    """Rows (token, size, seen): how often shingles that recur were seen in a part of the rows
    (size null); how many sets have a small size (token null); all shingles (both null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, total = Shingler(k), [], 0, 0
        counts, small = Counts(COUNTED), np.zeros(161, np.int64)
        for _, texts in text_slices(batches, "text", SLICE):
            for s in shingler.sets(texts):
                size += len(s)
                held.append(s)
                small[min(len(s), 161) - 161] += len(s) <= 160
            if size >= 1 << 18:
                counts.add(held)
                total, held, size = total + size, [], 0
        counts.add([*held, np.empty(0, np.uint64)])
        again = counts.counts > 1
        lengths = np.flatnonzero(small)
        for part in np.array_split(np.flatnonzero(again), max(1, int(again.sum()) >> 16)):
            yield pa.RecordBatch.from_arrays([pa.array(counts.hashes[part].view(np.int64)), pa.nulls(len(part), pa.int64()), pa.array(counts.counts[part])], ["token", "size", "seen"])
        none = pa.nulls(len(lengths) + 1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array([*lengths.tolist(), None], pa.int64()), pa.array([*small[lengths].tolist(), total + size], pa.int64())], ["token", "size", "seen"])

    return work


def _bitmap(s: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.bincount((s >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def need(n, a: int, b: int):
    """Overlap that a set of n needs with any partner: ceil(a n / b)."""
    return -(-a * n // b)


def subsets(n: int, a: int, b: int) -> int:
    p = min(n, n - need(n, a, b) + 2)
    return p * (p - 1) // 2


def boundary(sizes: dict[int, int], met: float, a: int, b: int) -> int:
    """The light size limit of least cost. met: list entries that a list scan meets on average."""
    best, at = None, 1
    for limit in range(1, 129):
        cost = 0.0
        for n, count in sizes.items():
            if n < 2:
                continue
            single = n - need(n, a, b) + 1
            light = n <= limit and need(n, a, b) >= 2
            cost += count * subsets(n, a, b) if light else count * single * (1 + met)
            if light and b * n >= a * (limit + 1):
                cost += count * single
        if best is None or cost < best:
            best, at = cost, limit
    return at


def lone(n: int, a: int, b: int) -> bool:
    """Whether a set of n can reach a/b with no set but itself."""
    return a * n > b * (n - 1) and 2 * a * n > (n - 1) * (a + b) and b * n < a * (n + 1)


def entries(order: np.ndarray, a: int, b: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set whose elements come in the global order, and the largest partner of each."""
    n = len(order)
    if n == 0 or lone(n, a, b):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c, keys, left = int(need(n, a, b)), [], []
    light = n <= limit and c >= 2
    if light:
        i, j = np.triu_indices(min(n, n - c + 2), 1)
        x, y = order[i], order[j]
        with np.errstate(over="ignore"):
            keys.append(mix(np.minimum(x, y) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(x, y)))
        left.append(n - j + 1)
    # partners that list single shingles only: larger ones beyond the boundary, or tiny ones
    if not light or b * n >= a * (limit + 1) or need(int(need(n, a, b)), a, b) < 2:
        j = np.arange(n - c + 1)
        keys.append(order[: len(j)])
        left.append(n - j)
    return np.concatenate(keys), np.concatenate(left) * (a + b) // a - n


def _listed(parts: list[np.ndarray], kind, none: list[bool] | None = None) -> pa.Array:
    """An Arrow list array of numpy arrays."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind, copy=False))
    offsets = pa.array(ends, mask=np.array([*none, False])) if none and any(none) else pa.array(ends)
    return pa.ListArray.from_arrays(offsets, values)


def digest_of(s: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sign_worker(k: int, a: int, b: int, limit: int, frequent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        tokens, counts = frequent.value
        none = np.empty(0, np.int64)
        for batch, texts in text_slices(batches, "text", SLICE):
            sets = shingler.sets(texts)
            keys, most, digests, bitmaps, wide = [], [], [], [], []
            for s in sets:
                order = s
                if len(tokens) and len(s):
                    at = np.searchsorted(tokens, s)
                    at[at == len(tokens)] = 0
                    rank = np.where(tokens[at] == s, counts[at], 0)
                    if rank.any():
                        order = s[np.argsort(rank, kind="stable")]
                own, top = entries(order, a, b, limit)
                keys.append(own.view(np.int64))
                most.append(top)
                digests.append(digest_of(s))
                bitmaps.append(_bitmap(s) if len(own) else none)
                wide.append(_bitmap(s, WIDE) if len(own) and len(s) > WIDE_FROM else none)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "mark")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    _listed(keys, np.int64),
                    _listed(most, np.int32),
                    _listed(bitmaps, np.int64),
                    _listed(wide, np.int64, [not len(w) for w in wide]),
                ],
                ["row", "doc_id", "mark", "n", "h1", "h2", "keys", "most", "bits", "wide"],
            )

    return work


def _set_worker(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch, texts in text_slices(batches, "text", SLICE):
            sets = shingler.sets(texts)
            digests = [digest_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "h1", "h2", "tokens"],
            )

    return work


def _verify_worker(a: int, b: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(b * inter >= a * (len(s) + len(t) - inter))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return work


def _differ(x: str, y: str):
    """Hamming distance of two arrays of longs."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda p, q: p + q)


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, ws: Workspace, name: str, k: int, a: int, b: int) -> DataFrame:
    """The pairs (u, v) of rows whose whole sets reach a/b. The sketches go first."""
    pairs = ws.save(pairs, f"{name}-tried")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    met = reps.join(maybe_broadcast(ids, PICKED), "row", "left_semi")
    side = lambda x: met.select(F.col("row").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "bits", "wide")])
    reach = (F.col("nu") + F.col("nv")) * (b - a)
    near = (_differ("bitsu", "bitsv") * (a + b) <= reach) & F.coalesce(_differ("wideu", "widev") * (a + b) <= reach, F.lit(True))
    pairs = ws.save(pairs.join(side("u"), "u").join(side("v"), "v").filter(near).select("u", "v"), f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    picked = ws.save(reps.join(maybe_broadcast(ids, PICKED), "row", "left_semi").select("row", "doc_id", "h1", "h2"), f"{name}-picked")
    wanted = picked.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.join(maybe_broadcast(wanted, PICKED), docs.doc_id == F.col("id"), "left_semi").select("doc_id", "text")
    sets = arrow_map(texts, _set_worker(k), "doc_id long, h1 long, h2 long, tokens binary")
    # of rows that share an id, those of this very set
    sets = ws.save(sets.join(maybe_broadcast(picked, LEFT_OUT), ["doc_id", "h1", "h2"]).select("row", "tokens").dropDuplicates(["row"]), f"{name}-sets")
    left = sets.select(F.col("row").alias("u"), F.col("tokens").alias("tu"))
    right = sets.select(F.col("row").alias("v"), F.col("tokens").alias("tv"))
    full = pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv")
    links = ws.save(arrow_map(full, _verify_worker(a, b), "u long, v long"), f"{name}-links")
    ws.drop(f"{name}-tried", f"{name}-pairs", f"{name}-picked", f"{name}-sets")
    return links


def _far(x: str, y: str, parts: int):
    differ = [F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(parts)]
    return sum(differ[1:], differ[0])


def _folded(i: int):
    """Part i of the folded sketch, whose distance never exceeds the symmetric difference either."""
    return reduce(lambda p, q: p.bitwiseXOR(q), [F.col("bits")[j] for j in range(i, BITS // 64, FOLD)])


def _orders(docs: DataFrame, ws: Workspace, k: int, a: int, b: int):
    """The most frequent shingles with their counts, broadcast; and the boundary of least cost."""
    spark = docs.sparkSession
    counted = ws.save(
        arrow_map(docs.select("text"), _count_worker(k), "token long, size long, seen long").groupBy("token", "size").agg(F.sum("seen").alias("seen")), "counts"
    )
    sizes = {r["size"]: r["seen"] for r in counted.filter("token is null and size is not null").collect()}  # at most 161 rows
    total = counted.filter("token is null and size is null").agg(F.sum("seen")).first()[0] or 0
    tokens = counted.filter("token is not null")
    met = (tokens.agg(F.sum(F.col("seen").cast("double") * F.col("seen"))).first()[0] or 0.0) / max(1, total)
    top = tokens.orderBy(F.desc("seen"), "token").limit(FREQUENT).select("token", "seen").toPandas()
    hashes = top.token.to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    ws.drop("counts")
    return spark.sparkContext.broadcast((hashes[by], top.seen.to_numpy(np.int64)[by])), boundary(sizes, met, a, b)


def _grouped(docs: DataFrame, k: int, num: int, den: int, ws: Workspace) -> DataFrame:
    """docs: row (unique), doc_id, mark, text (binary). row, doc_id, mark, n, component (a row's
    number) and component_id (the component's least doc_id) of each."""
    a, b = num, den
    frequent, limit = _orders(docs, ws, k, a, b)
    schema = "row long, doc_id long, mark long, n long, h1 long, h2 long, keys array<long>, most array<int>, bits array<long>, wide array<long>"
    signed = ws.save(arrow_map(docs, _sign_worker(k, a, b, limit, frequent), schema), "signed")
    narrow = signed.select("row", "doc_id", "mark", "n", "h1", "h2")
    real = narrow.filter("n > 0 and doc_id is not null")
    copies = real.groupBy("h1", "h2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    copies = ws.save(copies.filter("copies > 1").drop("copies"), "copies")
    # signatures are wide, so they stay where they are: what is left out of them is found on narrow rows
    placed = narrow.join(maybe_broadcast(copies, LEFT_OUT), ["h1", "h2", "n"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    placed = ws.save(
        placed.select("row", "doc_id", "mark", "n", F.when(own, F.coalesce("node", "row")).otherwise(F.col("row")).alias("node"), F.when(own, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("least")), "placed"
    )
    gone = placed.filter("row <> node").select("row")
    reps = signed.filter("size(keys) > 0 and doc_id is not null").join(maybe_broadcast(gone, LEFT_OUT), "row", "left_anti")
    reps = ws.save(reps.select("row", "doc_id", "n", "h1", "h2", "keys", "most", "bits", "wide"), "reps")
    ws.drop("signed", "copies")
    labels = _linked(docs, reps, k, a, b, ws)
    # the least id of each component with links
    heads = placed.join(labels, "node").groupBy("label").agg(F.min("least").alias("head"))
    heads = ws.save(labels.join(heads, "label"), "heads")
    return placed.join(heads, "node", "left").select(
        "row", "doc_id", "mark", "n", F.coalesce("label", "node").alias("component"), F.coalesce("head", "least").alias("component_id")
    )


def _linked(docs: DataFrame, reps: DataFrame, k: int, a: int, b: int, ws: Workspace) -> DataFrame:
    """(node, label) of all distinct sets that reach a/b with another."""
    posts = reps.select("row", "n", F.explode(F.arrays_zip("keys", "most")).alias("e")).select("row", "n", F.col("e.keys").alias("key"), F.col("e.most").alias("most"))
    entry = F.struct("row", "n", "most")
    lists = posts.groupBy("key").agg(
        F.count("*").alias("members"), F.min(entry).alias("x"), F.max(entry).alias("y"), F.min("n").alias("lo"), F.max("most").alias("hi"),
        F.sum(F.xxhash64("row", "most").cast("decimal(20,0)")).alias("same"),
    )
    lists = ws.save(lists.filter("members > 2 or (members = 2 and x.n <= y.most and y.n <= x.most)"), "lists")
    twos = lists.filter("members = 2").select(F.col("x.row").alias("u"), F.col("y.row").alias("v")).distinct()
    # lists of the same entries count once
    more = lists.filter("members > 2").groupBy("members", "same").agg(F.min(F.struct("key", "lo", "hi")).alias("l")).select("l.*")
    xs = [f"x{i}" for i in range(FOLD)]
    folded = reps.select("row", *[_folded(i).alias(x) for i, x in enumerate(xs)])
    kept = ws.save(posts.join(more, "key").filter("most >= lo and n <= hi").select("key", "row", "n", "most"), "kept")
    posts = ws.save(kept.join(folded, "row"), "posts")
    ws.drop("kept")

    # a few leaders of each list, the nearest ones tried first
    me = F.struct("row", "n", "most", *xs)
    slack = F.col("most") - F.col("n")
    wanted = [F.max_by(me, F.struct(slack, F.xxhash64("row", F.lit(s)))) for s in range(CENTRAL)]
    wanted += [F.min_by(me, F.xxhash64("row", F.lit(s), "key")) for s in range(LEADERS - CENTRAL)]
    chosen = posts.groupBy("key").agg(*[w.alias(f"l{i}") for i, w in enumerate(wanted)])
    tried = (
        posts.join(chosen.select("key", F.explode(F.array_distinct(F.array(*[f"l{s}" for s in range(LEADERS)]))).alias("l")), "key")
        .select("row", "n", "most", *xs, F.col("l.row").alias("other"), F.col("l.n").alias("on"), F.col("l.most").alias("om"), *[F.col(f"l.{x}").alias(f"y{i}") for i, x in enumerate(xs)])
        .filter("row <> other and n <= om and on <= most")
        .withColumn("far", _far("x", "y", FOLD))
        .filter(F.col("far") * (a + b) <= (F.col("n") + F.col("on")) * (b - a))
    )
    best = Window.partitionBy("row").orderBy("far", F.xxhash64("row", "other"))
    pairs = (
        tried.select("row", "other", "far").distinct().withColumn("r", F.row_number().over(best)).filter(F.col("r") <= TRIES)
        .select(F.least("row", "other").alias("u"), F.greatest("row", "other").alias("v")).unionByName(twos).distinct()
    )
    links = _verified(docs, reps, pairs, ws, "first", k, a, b)
    ws.drop("lists")
    labels = components(links, ws, "cc1")

    # what is left: pairs across components within a list
    placed = posts.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    xs = [f"x{i}" for i in range(BITS // 64)]
    whole = reps.select("row", *[F.col("bits")[i].alias(x) for i, x in enumerate(xs)])
    placed = ws.save(placed.join(mixed, "key").select("key", "row", "n", "most", "label").join(whole, "row"), "mixed")
    p = placed.select("key", F.col("row").alias("u"), "n", F.col("most").alias("pm"), F.col("label").alias("lu"), *xs)
    q = placed.select(F.col("key").alias("key2"), F.col("row").alias("v"), F.col("n").alias("m"), F.col("most").alias("qm"), F.col("label").alias("lv"), *[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)])
    across = p.join(
        q,
        (F.col("key") == F.col("key2"))
        & (F.col("u") < F.col("v"))
        & (F.col("lu") != F.col("lv"))
        & (F.col("n") <= F.col("qm"))
        & (F.col("m") <= F.col("pm"))
        & (_far("x", "y", BITS // 64) * (a + b) <= (F.col("n") + F.col("m")) * (b - a)),
    )
    more = _verified(docs, reps, across.select("u", "v").distinct(), ws, "second", k, a, b)
    ws.drop("posts", "mixed")
    if more.limit(1).count():
        # components of components: labels are nodes now
        lab = labels.select("node", "label")
        lift = (
            more.join(lab.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u", "left")
            .join(lab.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v", "left")
            .select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        )
        upper = components(lift, ws, "cc2").select(F.col("node").alias("was"), F.col("label").alias("top"))
        whole = links.unionByName(more).select(F.explode(F.array("u", "v")).alias("node")).distinct()
        labels = (
            whole.join(lab, "node", "left").withColumn("was", F.coalesce("label", "node")).drop("label")
            .join(upper, "was", "left").select("node", F.coalesce("top", "was").alias("label"))
        )
    return ws.save(labels, "labels")


def _numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """row, doc_id, mark (hash of the text) and text as bytes. Rows are numbered as they are
    signed, and the signatures are written, so each number is made once only."""
    text = F.encode(F.col("text").cast("string"), "UTF-8")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), text.alias("text"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Sets of distinct k-word shingles and the components of documents whose sets reach num/den.

    docs: doc_id (integer) and text; further columns are ignored. Returns doc_id, n_shingles
    and component_id, one row for each row of docs. Null or empty texts: no shingles, component
    of their own. Repeated rows are linked like one. Rows that share a doc_id but not their text
    are linked each by its own text. A null doc_id is never linked; its component_id is null. An
    empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    found = _grouped(_numbered(docs, ws), k, num, den, ws)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_duplicates_removed(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the near duplicates: of each component the row of least doc_id stays.

    Rows with a null doc_id, and texts without words, stay. Where several texts of one component
    share the least doc_id, one of them stays; so does one of rows repeated in doc_id and text.
    Texts that share an id and nothing else all stay. Further columns may have any names.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    found = ws.save(_grouped(_numbered(docs, ws), k, num, den, ws).filter("doc_id is not null and n > 0"), "found")
    heads = found.filter("doc_id = component_id").groupBy("component").agg(F.min("mark").alias("kept"), F.max("mark").alias("other"))
    heads = heads.filter("kept <> other").drop("other")
    below = found.filter("doc_id <> component_id").select("doc_id", "mark")
    beside = found.filter("doc_id = component_id").join(maybe_broadcast(heads, LEFT_OUT), "component").filter("mark <> kept").select("doc_id", "mark")
    gone = ws.save(below.unionByName(beside).distinct(), "gone")
    again = ws.save(found.filter("doc_id = component_id").groupBy("doc_id", "mark").agg(F.count("*").alias("times")).filter("times > 1").drop("times"), "again")
    names = list(docs.columns)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    kept = wide.join(maybe_broadcast(gone, LEFT_OUT), ["doc_id", "mark"], "left_anti")
    if again.limit(1).count():
        again = maybe_broadcast(again, LEFT_OUT)
        once = kept.join(again, ["doc_id", "mark"], "left_anti")
        twice = kept.join(again, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.first("r").alias("r")).select("r", "doc_id", "mark")
        kept = once.unionByName(twice)
    return kept.select("r.*")
