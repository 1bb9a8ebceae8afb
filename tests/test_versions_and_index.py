"""Versioned chunk sets and the inverted index against plain versions, through changes and failures."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docuflux import registry
from docuflux.operators import index, retrieval
from docuflux.operators import versions as vs

from .compare import same


@pytest.fixture
def store(spark, tmp_path):
    return vs.Versions(spark, f"file://{tmp_path}/store", 8)


def documents(spark, docs, status="ready"):
    """{doc_id: (hash, [chunks])}"""
    chunks = [(d, i, c, f"text of {c}") for d, (_, cs) in docs.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(chunks, vs.CHUNKS), spark.createDataFrame([(d, h, status) for d, (h, _) in docs.items()], "doc_id long, content_hash string, status string")


def stored(store):
    chunks = defaultdict(list)
    for r in store.read("chunks", vs.CHUNKS).orderBy("doc_id", "place").collect():
        chunks[r.doc_id].append(r.chunk_hash)
    return {r.doc_id: (r.content_hash, r.status, chunks.pop(r.doc_id, [])) for r in store.read("states", vs.STATES).collect()}, dict(chunks)


def test_documents_are_replaced_whole(spark, store):
    vs.replace_documents(store, *documents(spark, {i: (f"h{i}", [f"a{i}", f"b{i}", f"b{i}"]) for i in range(30)}))
    before = store.manifest()
    vs.replace_documents(store, *documents(spark, {3: ("new", ["c3"]), 4: ("h4", ["not read"]), 5: ("empty", []), 40: ("h40", ["x"])}))
    after = store.manifest()
    wanted = {i: (f"h{i}", "ready", [f"a{i}", f"b{i}", f"b{i}"]) for i in range(30)} | {3: ("new", "ready", ["c3"]), 5: ("empty", "ready", []), 40: ("h40", "ready", ["x"])}
    assert stored(store) == (wanted, {})
    # only buckets of changed documents have new folders, and the version before can still be read
    of = {r.doc_id: str(r.b) for r in spark.range(41).select(F.col("id").alias("doc_id")).withColumn("b", vs.bucket("doc_id", 8)).collect()}
    moved = {b for b, p in after["tables"]["states"].items() if before["tables"]["states"].get(b) != p}
    assert moved == {of[3], of[5], of[40]}
    assert store.read("chunks", vs.CHUNKS, manifest=before).count() == 90
    assert store.manifest(1) == before and vs.replace_documents(store, *documents(spark, {3: ("new", ["ignored"])})) == after


def test_failure_before_the_swap_leaves_the_version(spark, store, monkeypatch):
    vs.replace_documents(store, *documents(spark, {i: (f"h{i}", [f"a{i}"]) for i in range(9)}))
    before = stored(store)

    def fails(manifest):
        raise OSError("lost")

    monkeypatch.setattr(store, "_swap", fails)
    with pytest.raises(OSError):
        vs.replace_documents(store, *documents(spark, {i: ("other", ["b"]) for i in range(9)}))
    monkeypatch.undo()
    assert stored(store) == before and store.number() == 1
    vs.replace_documents(store, *documents(spark, {0: ("other", ["b"])}))
    assert stored(store)[0][0] == ("other", "ready", ["b"]) and stored(store)[0][8] == before[0][8]
    # folders of the failed change go, those that versions name stay
    assert store.vacuum() == 2 and stored(store)[0][0] == ("other", "ready", ["b"])


def test_second_of_two_changes_fails(spark, store):
    rows = spark.createDataFrame([(1, 0)], "doc_id long, bucket int")
    base = store.manifest()
    store.commit(base, {"t": (rows, [0])}, {})
    with pytest.raises(vs.Conflict):
        store.commit(base, {"t": (rows.withColumn("doc_id", F.lit(2)), [0])}, {})
    assert [r.doc_id for r in store.read("t", "doc_id long").collect()] == [1]
    with pytest.raises(ValueError, match="not replaced"):
        store.commit(store.manifest(), {"t": (rows, [1])}, {})


def bm25(texts, asked, k):
    docs = {i: (x or "").lower().split() for i, x in texts.items()}
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, long = sum(idf.values()) / len(idf), sum(map(len, docs.values())) / len(docs)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, text in asked.items():
        scores = {}
        for i, d in docs.items():
            tf = Counter(d)
            parts = [idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / long)) for w in text.lower().split() if w in tf]
            if parts:
                scores[i] = sum(parts)
        out |= {(q, i): (n + 1, round(scores[i], 6)) for n, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k])}
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def test_index_through_changes_equals_a_rebuild(spark, tmp_path):
    rng, store = random.Random(4), vs.Versions(spark, f"file://{tmp_path}/index", 16)
    vocabulary = [f"w{i}" for i in range(60) for _ in range(60 // (i + 1))]
    make = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))
    texts = {i: make() for i in range(120)} | {500: None, 501: "", 502: "Only ONE word word"}
    asked = {q: make() + " nowhere" for q in range(8)} | {20: "word", 21: "nothing of it"}
    questions = spark.createDataFrame(list(asked.items()), "query_id long, text string")

    def searched(k):
        return {(r.query_id, r.id): (r.rank, round(r.score, 6)) for r in index.search(store, questions, k).collect()}

    index.update(store, frame(spark, texts))
    assert searched(5) == bm25(texts, asked, 5)
    for change in ({3: make(), 7: make(), 900: make()}, {502: "one other rare1 rare1"}):
        gone = [11, 12, 7000] if 3 in change else []
        index.update(store, frame(spark, change), spark.createDataFrame([(i,) for i in gone], "id long"))
        texts = {i: x for i, x in (texts | change).items() if i not in gone}
        for k in (1, 500) if 3 in change else (5,):
            assert searched(k) == bm25(texts, asked, k)
    # a change of rare words leaves the postings of other buckets where they are
    before = store.manifest()
    index.update(store, frame(spark, {502: "rare2"}))
    after = store.manifest()
    moved = [b for b in set(before["tables"]["postings"]) | set(after["tables"]["postings"]) if before["tables"]["postings"].get(b) != after["tables"]["postings"].get(b)]
    assert 1 <= len(moved) <= 4  # one, other, rare1 and rare2
    rebuilt = vs.Versions(spark, f"file://{tmp_path}/rebuilt", 16)
    index.update(rebuilt, frame(spark, texts | {502: "rare2"}))
    for name, schema in (("postings", index.POSTINGS), ("terms", index.TERMS)):
        assert sorted(map(tuple, store.read(name, schema).collect())) == sorted(map(tuple, rebuilt.read(name, schema).collect()))
    assert after["facts"] == rebuilt.manifest()["facts"]


def test_bounds_leave_out_postings(spark, tmp_path):
    """A rare word decides a query; the common one's postings count only where the rare one is."""
    store = vs.Versions(spark, f"file://{tmp_path}/index", 8)
    texts = {i: "common " + f"filler{i} " * 3 + ("rare rare rare" if i % 40 == 0 else "") + (" half" if i % 3 == 0 else "") for i in range(400)}
    index.update(store, frame(spark, texts))
    asked = spark.createDataFrame([(1, "rare common half")], "query_id long, text string")
    terms = {r.term: r.needed for r in index.essential(store, asked, 5, store.manifest()).collect()}
    assert terms == {"rare": True, "half": False, "common": False}
    whole = retrieval.top(retrieval.bm25(frame(spark, texts), asked, "id"), 5)
    assert [(r.id, round(r.score, 6)) for r in index.search(store, asked, 5).orderBy("rank").collect()] == [(r.id, round(r.score, 6)) for r in whole.orderBy("rank").collect()]


def test_empty_index(spark, tmp_path):
    store, asked = vs.Versions(spark, f"file://{tmp_path}/index"), spark.createDataFrame([(1, "x")], "query_id long, text string")
    assert index.search(store, asked, 3).collect() == [] and index.update(store, spark.createDataFrame([], "id long, text string"))["version"] == 0
    index.update(store, frame(spark, {1: "x"}))
    index.update(store, spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1,)], "id long"))
    assert store.manifest()["facts"] == {"n": 0, "total": 0} and index.search(store, asked, 3).collect() == []


@pytest.mark.parametrize("blocks", [(256, 2_000_000), (2, 40)])
def test_best_bm25_as_all_scores(spark, monkeypatch, blocks):
    """Copies, frequent words with negative weights, words of no document; few rows go on."""
    monkeypatch.setattr(retrieval, "TERM_BLOCK", blocks[0])
    monkeypatch.setattr(retrieval, "CELLS_AT_ONCE", blocks[1])
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40) for _ in range(40 // (i + 1))]
    make = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))
    texts = {i: make() for i in range(200)} | {300 + i: "W0 w1\tw1" for i in range(60)} | {500: "", 501: "Only ONE word word"}
    asked = {q: make() + " nowhere" for q in range(7)} | {20: "word", 21: "nothing of it", 22: "w0 w1 w1", 23: ""}
    questions = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for k in (1, 5, 400):
        found = retrieval.best_bm25(frame(spark, texts).repartition(3), questions, k, "id")
        assert {(r.query_id, r.id): (r.rank, round(r.score, 6)) for r in retrieval.top(found, k).collect()} == bm25(texts, asked, k)
    few = retrieval.best_bm25(frame(spark, texts).coalesce(1), questions, 5, "id")
    assert few.groupBy("query_id").count().filter("count > 10").isEmpty()
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 3)
    assert {(r.query_id, r.id): (r.rank, round(r.score, 6)) for r in retrieval.top(retrieval.best_bm25(frame(spark, texts), questions, 5, "id"), 5).collect()} == bm25(texts, asked, 5)


def test_documents_without_text_count(spark, tmp_path):
    """As in the SQL, they are of the corpus' size and not of the mean length."""
    texts = {i: f"common a{i % 7} b{i % 3}" for i in range(30)} | {i: None for i in range(30, 45)}
    frame(spark, texts).withColumnRenamed("id", "doc_id").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "a1 common"), (2, "b2 a3 a3")], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    for name in ("a2_bm25", "r1_gate"):
        same(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], tmp_path)


def test_words_of_an_update_are_read_twice(spark, tmp_path):
    """For the chunks and for the postings, as the other tables come from those; many candidates are not joined."""
    store, reads = vs.Versions(spark, f"file://{tmp_path}/index", 4), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    texts = {i: f"common a{i % 7} a{i % 7} b{i}" for i in range(90)}
    index.update(store, frame(spark, texts).repartition(2).cache().select("id", read.asNondeterministic()("text").alias("text")))
    assert reads.value == 180


def test_many_candidates(spark, tmp_path, monkeypatch):
    store, texts, asked = vs.Versions(spark, f"file://{tmp_path}/index", 4), {i: f"common a{i % 7} a{i % 7} b{i}" for i in range(90)}, {1: "common a3 b4", 2: "a1 a1 b9 common"}
    monkeypatch.setattr(index, "ROWS", 7)
    index.update(store, frame(spark, texts).coalesce(1))
    for most in (0, 1_000_000):
        monkeypatch.setattr(index, "BROADCAST_ROWS", most)
        found = index.search(store, spark.createDataFrame(list(asked.items()), "query_id long, text string"), 5)
        assert {(r.query_id, r.id): (r.rank, round(r.score, 6)) for r in found.collect()} == bm25(texts, asked, 5)
