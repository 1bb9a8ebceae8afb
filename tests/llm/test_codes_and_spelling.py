"""Vector codes against plain Lloyd rounds, spelling variants against open patterns, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from docuflux.llm import queries, spelling, vectorcodes

from ..compare import TINY


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // parts)
    cut = []
    for _, v in kept:
        whole = [math.floor(Fraction(x) * scale) for x in v] + [0] * (width * parts - len(v))
        cut.append([tuple(whole[p * width : (p + 1) * width]) for p in range(parts)])
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def codes():
        return [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = codes()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    rows = [(i is None, i or 0, bytes(a), sum(far(c[p], books[p][a[p]]) for p in range(parts))) for (i, _), c, a in zip(kept, cut, codes(), strict=True)]
    return sorted(rows), ",".join(str(x) for part in books for entry in part for x in entry)


def coded(df):
    codes, books = vectorcodes.coded(df)
    return sorted((r.vec_id is None, r.vec_id or 0, bytes(r.code), r.error) for r in codes.collect()), books.text()


def fits(rows):
    return [(*r[:3], r[3] if r[3] < 1 << 63 else None) for r in rows]


@pytest.mark.parametrize("size", [1.0, 1e9, 1e300])
def test_codes_of_odd_vectors(spark, size):
    """Null, repeated and tied ids, lengths of 0 to 11, components beyond 64 bits, vectors to leave out."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), [rng.choice([-1.0, 0.0, 0.5, rng.random() * size]) for _ in range(rng.randint(0, 11))], rng.choice([None, 1, 2])) for _ in range(90)]
    rows += [(50, None, 1), (51, [None, 1.0], 1), (52, [math.nan], None), (53, [math.inf], 2), (3, [0.5] * 8, 1), (3, [0.5] * 8, 1)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, codes string")
    plain, books = lloyd(rows)
    assert coded(df) == (fits(plain), books)


def test_codes_of_clusters_are_measured_rarely(spark):
    """In settled codebooks only parts at the heaps' tops are measured again."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-4000, 4000, (16, 8))
    parts = entries[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 8))
    codes, slack = vectorcodes.nearest(parts, entries)
    keys = slack * vectorcodes.BLOCK + np.arange(3000)
    heaps = [np.sort(keys[codes == e]) for e in range(16)]
    moved = entries + rng.integers(-3, 3, entries.shape)
    step = [math.isqrt(int(x)) + 1 for x in ((moved - entries) ** 2).sum(1)]
    drift = [s + max(step[:e] + step[e + 1 :]) for e, s in enumerate(step)]
    _, rows = vectorcodes.settled(heaps, parts, codes, moved, drift)
    assert len(rows) < 30 and (codes == vectorcodes.distances(parts, moved).argmin(1)).all()


def test_codes_without_vectors(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    codes, books = vectorcodes.coded(df)
    assert books is None and vectorcodes.with_label_error(codes).collect() == []
    one = df.sparkSession.createDataFrame([(1, [0.5], None), (2, [0.25], None)], df.schema)
    rows = vectorcodes.with_label_error(vectorcodes.coded(one)[0]).collect()
    assert {(r.vec_id, r.error, r.label_error) for r in rows} == {(1, 0, 0), (2, 0, 0)}


def test_label_errors_are_summed(spark):
    df = spark.createDataFrame([(1, 7, 3), (2, 7, 4), (3, None, 5), (4, None, 6)], "vec_id long, label int, error long")
    assert {r.vec_id: r.label_error for r in vectorcodes.with_label_error(df).collect()} == {1: 7, 2: 7, 3: 11, 4: 11}


def counted(rows):
    low, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(words):
    open_, out = defaultdict(lambda: (set(), set())), defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            open_[w[:i], w[i:]][1].add(w)
            if i < len(w):
                open_[w[:i], w[i + 1 :]][0].add(w)
    for same, shorter in open_.values():
        for a in same:
            out[a] |= same | shorter
            for b in shorter:
                out[b].add(a)
    return {w: sorted(out[w] - {w}) for w in words}


def plain(words):
    links, form, out = near(words), {}, {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(links[w]), words.get(form.get(w)))
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("limit", [spelling.GROUP, 3])
def test_variants_of_crowded_words(spark, limit):
    """Two letters only, so that groups are crowded, and words of thousands of letters; with a limit
    of three all groups are halved down to single positions."""
    rng = random.Random(3)
    words = {"".join(rng.choice("aé") for _ in range(rng.randint(7, 11))): rng.choice([2, 3, 5, 20, 50, 700]) for _ in range(300)}
    words |= {"a" * 3000: 5, "a" * 3001: 50, "b" * 2000 + "c" + "b" * 2000: 3, "b" * 4001: 30}
    df = spark.createDataFrame([(*r, 1) for r in words.items()], "word string, n long, m int")
    assert found(spelling.variants(df, limit)) == plain(words)
    assert sorted((r.word, r.near) for r in spelling.links(df, limit).collect()) == sorted((w, v) for w, vs in near(words).items() for v in vs)


def test_words_of_documents(spark):
    rows = [(1, "", "x"), (2, None, "x"), (None, "Wörterbuch wörterbuch", "x"), (3, "ÄPFELBAUM äpfelbaum Äpfelbaum", "x"), (4, "straßenbahn " * 5000, "x"), (4, "straßenbahn", "x"), (5, "1234567 abcdef abc_defghij", "x"), (6, "z" * 100000 + " " + "z" * 100000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert {r.word: r.n for r in spelling.words(df).collect()} == counted([r[:2] for r in rows])
    assert spelling.variants(spelling.words(df.limit(0))).collect() == []


def test_variants_over_all_documents(spark):
    rows = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.op12_spelling_variants(spark, TINY)) == plain(counted(rows))


def test_wavelet_tree_reports_ranges():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)
    tree = spelling.WaveletTree(values)
    a, c = rng.integers(0, 500, 200), rng.integers(0, 500, 200)
    b, d = rng.integers(a, 501), rng.integers(c, 501)
    query, value = tree.report(a, b, c, d)
    wanted = {(q, int(v)) for q in range(200) for v in values[a[q] : b[q]] if c[q] <= v < d[q]}
    assert set(zip(query.tolist(), value.tolist(), strict=True)) == wanted and len(query) == len(wanted)
