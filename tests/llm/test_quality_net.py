"""The byte network against plain loops over chunks and against differences, its held-out accuracy and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuflux.llm import quality_net, queries

from ..compare import TINY


def words(rng, n, junk):
    if junk:
        return " ".join([rng.choice(["und", "the", "wher."])] * n)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuwz") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def toy():
    rng = random.Random(1)
    rows = [(words(rng, rng.randint(20, 200), i % 4 == 0).encode(), int(i % 4 != 0)) for i in range(160)]
    return quality_net.Model(*zip(*rows, strict=True)), rng


def plain(model, text):
    """A text's probability, filter by filter and chunk by chunk."""
    p, wide, data = model.network.p, quality_net.WIDE, text or b""
    places = max(len(data) - wide + 1, min(len(data), 1))
    data, logits, start = data + bytes(wide), [], 0
    while True:
        held = min(quality_net.CHUNK, places - start)
        z = np.zeros(quality_net.FILTERS)
        if held > 0:
            answers = [p["embed"][list(data[i : i + wide])].ravel() @ p["filters"] + p["shift"] for i in range(start, start + held)]
            z = np.maximum(np.max(answers, 0), 0)
        h = np.maximum(np.append(z, math.log1p(held) / 6) @ p["hidden"] + p["hb"], 0)
        logits.append(float(np.clip(h @ p["out"] + p["ob"][0], -10, 10)))
        start += quality_net.STRIDE
        # a chunk begins at each block but the last, which belongs to the chunk before
        if places <= start + quality_net.STRIDE:
            break
    return 1 / (1 + math.exp(-(np.array([sum(logits) / len(logits), min(logits)]) @ model.line[:-1] + model.line[-1])))


def test_scores_equal_plain_loops(toy):
    model, rng = toy
    texts = [b"", None, b"a", b"abcde", b"abcdef", "é\n".encode() * 3]
    texts += [words(rng, 400, junk).encode()[:n] for junk in (0, 1) for n in (127, 128, 133, 134, 255, 256, 261, 262, 389, 390, 1000)]
    assert model.scores(texts) == pytest.approx([plain(model, t) for t in texts], abs=2e-4)


def test_all_bytes_count(toy):
    """A junk passage anywhere in a long text lowers its least chunk."""
    model, rng = toy
    good, junk = words(rng, 3000, False).encode(), words(rng, 150, True).encode()
    least = lambda t: model.summaries(quality_net.Blocks([t]))[0, 1]
    assert all(least(good[:at] + junk + good[at:]) < least(good) - 1 for at in (0, 5001, len(good)))


def test_gradients():
    rng, net = np.random.default_rng(0), quality_net.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, size, labels = rng.integers(97, 110, (5, 40 + quality_net.WIDE - 1)), np.array([40, 40, 3, 1, 20]), np.array([1, 0, 1, 0, 1.0])

    def loss():
        logits = net.logits(net.largest(rows, size), size)
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, logits, -logits)))))

    grads = net.gradients(rows, size, labels)
    for k, g in grads.items():
        flat = np.argsort(-np.abs(g).ravel())[:3]
        for at in flat:
            where = np.unravel_index(at, g.shape)
            net.p[k][where] += 1e-3
            up = loss()
            net.p[k][where] -= 2e-3
            down = loss()
            net.p[k][where] += 1e-3
            assert g[where] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def test_edge_cases(spark):
    rows = [(1, "", 1), (2, None, 1), (3, "x", 0), (4, "gute wörter", 0), (4, "gute wörter", 0), (None, "abc", 0), (5, "ab " * 200000, 1), (6, "und der " * 30, 1)]
    docs = spark.createDataFrame([(*r[:2], "x", r[2]) for r in rows], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 1, 1), (5, 0, 0), (6, None, 1), (None, 1, 1)], "doc_id long, quality int, text int")
    got = quality_net.scored(docs, labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert quality_net.scored(docs.limit(0), labels).collect() == [] and {r.score for r in quality_net.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert quality_net.without_poor(docs, labels).columns == docs.columns


def test_held_out_rows_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_net.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in quality_net.scored(docs, labels).collect()} == {(r.doc_id, r.score) for r in quality_net.scored(docs, turned).collect()}


def test_held_out_accuracy(spark):
    """Over the rows of sf0.1 that nothing was learned from."""
    folder = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(marks[r.doc_id], r.predicted) for r in queries.op13_quality_classifier(spark, folder).filter("held_out").collect() if marks.get(r.doc_id) is not None]
    poor, good = [p for y, p in rows if y == 0], [p for y, p in rows if y == 1]
    assert sum(p == 0 for p in poor) >= 0.95 * len(poor) and sum(p == 0 for p in good) <= 0.01 * len(good)
