"""Operators that SQL does not express, against plain versions of their own."""

import io
import random
import re
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuflux.functions import text as t
from docuflux.operators import blocks, groups, hierarchy, layout, operations, retrieval, structure
from docuflux.sources import files
from docuflux.streaming import rates

from .compare import TINY


def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}


def test_groups_cross_batches(spark):
    rows = spark.range(5000).selectExpr("id % 700 as k", "id as v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = groups.by_group(rows, ["k"], ["v"], lambda g: [{"k": g[0]["k"], "s": [r["v"] for r in g]}], "k long, s array<long>").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: r.s for r in got} == {k: list(range(k, 5000, 700)) for k in range(700)}


def test_masks(spark):
    given = docs(spark) | {9001: "tel +1 (555) 010-9999, 12345678901 x1234567890 4-4-4 a.b+c@d-e.org"}
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string").select("doc_id", t.masked(F.col("text")).alias("m"))
    for r in df.collect():
        text = re.sub(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", t.EMAIL_MASK, given[r.doc_id], flags=re.A)
        assert r.m == re.sub(r"(?<!\w)(?:\+?\d[\d\s().-]{6,}\d)(?!\w)", t.NUMBER_MASK, text, flags=re.A)


def test_sanitizer_by_scanning(spark):
    """One match at a time: the earliest, then the longest, then the first rule."""
    rng = random.Random(3)
    parts = ["a@b.co", "http://x.org:80/p?q", "1234567890", "1234-5678-9012-3456", "10.0.0.1", "AB123456", "+1-22-333", "00:1a:2b:3c:4d:5e", "fe80:0:0:1", "word", " ", "/", "é"]
    for text in [*list(docs(spark).values())[:40], *["".join(rng.choice(parts) + rng.choice([" ", "", "-"]) for _ in range(12)) for _ in range(200)]]:
        out, at = "", 0
        while True:
            best = None
            for n, (rule, new) in enumerate(structure.COMPILED):
                for m in rule.finditer(text):
                    if m.start() >= at and m.end() > m.start() and (best is None or (m.start(), -m.end(), n) < best[0]):
                        best = ((m.start(), -m.end(), n), new)
            if best is None:
                break
            out, at = out + text[at : best[0][0]] + best[1], -best[0][1]
        assert structure.sanitized_text(text) == out + text[at:]


def test_chunks_hold_the_text(spark):
    for text in docs(spark).values():
        pieces = structure.split_text(text)
        assert all(0 < len(p) <= structure.SIZE for p in pieces)
        at = 0  # each piece begins at or before the end of the one before it
        for p in pieces:
            found = text.find(p, max(0, at - structure.OVERLAP - 1))
            assert 0 <= found and not text[at:found].strip()
            at = found + len(p)
        assert not text[at:].strip()


def read_by_recursion(boxes, at):
    """Cuts of a page without wide boxes, as plainly as can be."""
    if len(at) < 2:
        return at

    def gap(spans):
        best, end = (0.0, 0.0), None
        for a, b in sorted(spans):
            if end is not None and a - end > best[0]:
                best = (a - end, (a + end) / 2)
            end = b if end is None else max(end, b)
        return best

    across, down = gap([(boxes[i][0], boxes[i][2]) for i in at]), gap([(-boxes[i][3], -boxes[i][1]) for i in at])
    if across[0] < 5 and len(at) >= 3:
        whole = max(boxes[i][2] for i in at) - min(boxes[i][0] for i in at)
        wide = [i for i in at if boxes[i][2] - boxes[i][0] >= 0.1 * whole]
        if 2 <= len(wide) < len(at) and gap([(boxes[i][0], boxes[i][2]) for i in wide])[0] >= 5:
            across = gap([(boxes[i][0], boxes[i][2]) for i in wide])
    if max(across[0], down[0]) >= 5:
        by_rows = down[0] >= 5 and (across[0] < 5 or down[0] > across[0])
        first = [i for i in at if (-(boxes[i][1] + boxes[i][3]) / 2 < down[1] if by_rows else (boxes[i][0] + boxes[i][2]) / 2 < across[1])]
        rest = [i for i in at if i not in first]
        if first and rest:
            return read_by_recursion(boxes, first) + read_by_recursion(boxes, rest)
    return sorted(at, key=lambda i: (-boxes[i][3], boxes[i][0]))


def test_reading_order(spark):
    rng, pages = random.Random(6), {}
    for page in range(120):
        boxes = []
        for _ in range(rng.randrange(1, 40)):
            x, y, w, h = rng.choice([50, 60, 300, 310, rng.randrange(500)]), rng.randrange(0, 780, 12), rng.choice([8, 180, 200, rng.randrange(1, 250)]), rng.choice([8, 10, 11, 60])
            boxes.append((float(x), float(y), float(x + w), float(y + h)))
        pages[page] = boxes
    df = spark.createDataFrame([(1, p, i, *b) for p, bs in pages.items() for i, b in enumerate(bs)], "doc_id long, page long, seq long, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in layout.reading_order(df).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append(r.seq)
    assert got == {p: read_by_recursion(b, list(range(len(b)))) for p, b in pages.items()}
    # a head across two columns is set aside, and comes back above what lies below its top
    boxes = [(0, 0, 40, 10), (60, 0, 100, 10), (0, 90, 100, 100), (0, 50, 40, 60), (60, 50, 100, 60)]
    assert layout.reading(boxes, beta=0.9) == [2, 3, 4, 0, 1]
    assert layout.reading([(0.0, float(i), 10.0, i + 0.5) for i in range(6000)])[:2] == [5999, 5998]


def test_breaker_by_clock(spark):
    rng, base, rows = random.Random(2), datetime(2024, 1, 1), []
    for key in range(40):
        at = 0
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice([1, 2, 40])
            rows.append((key, base + timedelta(seconds=at), rng.random() < 0.75))
    want = {}
    for key in range(40):
        bad, opened, refused, state = 0, None, 0, "closed"
        for _, ts, failed in (r for r in rows if r[0] == key):
            if opened is not None and (ts - opened).total_seconds() < 30:
                refused += 1
                continue
            if failed:
                bad += 1
                if bad >= 5:  # a failed trial keeps the count
                    opened, state = ts, "open"
            else:
                bad, opened, state = 0, None, "closed"
        want[key] = (state, refused)
    got = operations.breaker(spark.createDataFrame(rows, "key long, ts timestamp, failed boolean"), "key").collect()
    assert {r.key: (r.state, r.refused) for r in got} == want


def test_mmr_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(q, i, float(s), i + 1, v.tolist()) for q in range(6) for i, (s, v) in enumerate(zip(sorted(rng.random(9), reverse=True), rng.standard_normal((9, 5))))]
    got = {}
    for r in retrieval.mmr(spark.createDataFrame(rows, "query_id long, id long, score double, rank int, embedding array<double>"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(6):
        own, taken = [r for r in rows if r[0] == q], []
        cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
        while len(taken) < 4:
            left = [r for r in own if r[1] not in taken]
            taken.append(max(left, key=lambda r: (0.5 * r[2] - 0.5 * max((cos(r[4], own[x][4]) for x in taken), default=0) if taken else r[2], -r[3]))[1])
        assert got[q] == taken


ELEMENTS = "doc_id long, seq int, page int, type string, level int, content string"


def test_two_levels(spark):
    body = "Plain words here. " * 70
    rows = [
        (1, 0, 1, "paragraph", None, "before any head"), (1, 1, 1, "heading", 2, "First"), (1, 2, 1, "paragraph", None, "  one\n\n\n\ntwo  x "), (1, 3, 2, "table", None, " "), (1, 4, 3, "paragraph", None, body),
        (1, 5, 3, "heading", None, "Only a head"), (2, 0, 1, "paragraph", None, None),
    ]
    got = hierarchy.two_levels(spark.createDataFrame(rows, ELEMENTS)).orderBy("doc_id", "chunk_level", "section", "seq").collect()
    one = [r for r in got if r.chunk_level == 1]
    whole = "## First\n\none\n\n\n\ntwo  x\n\n" + body.strip()
    pieces = structure.split_text(whole)
    assert len(pieces) > 1
    clean = lambda x: re.sub(" {2,}", " ", re.sub("\n{3,}", "\n\n", x)).strip()
    assert [r.page_content for r in one] == ["before any head", *map(clean, pieces), "# Only a head"]
    assert [(r.page, r.page_end, r.heading_level, r.section_title) for r in one][1] == (1, 3, 2, "First")
    two = [r for r in got if r.chunk_level == 2]
    assert [r.page_content for r in two] == ["before any head", "one\n\ntwo x", clean(body)]
    heads = {r.section: r.chunk_hash for r in reversed(one)}
    assert all(r.parent_chunk_id == heads[r.section] for r in two) and {r.doc_id for r in got} == {1}


def test_expansion(spark):
    """Candidates one by one, as a reader would."""
    rng, rows = random.Random(4), []
    for q in range(30):
        for place in range(1, 13):
            high = rng.random() < 0.3
            rows.append((q, q * 100 + place, place, None if rng.random() < 0.1 else f"{'s' if high else 'e'}{rng.randrange(6)}", 1 if high else 2, None if high else f"s{rng.randrange(6)}"))
    got = {}
    for r in hierarchy.expanded(spark.createDataFrame(rows, "query_id long, id long, place int, chunk_hash string, chunk_level int, parent_chunk_id string"), 5).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(30):
        own, out, names = [r for r in rows if r[0] == q], [], []
        last = {r[3]: r for r in own if r[3]}
        for r in own:
            if len(out) < 5 and (r[3] or r[1]) not in names:
                out.append(r[1])
                names.append(r[3] or r[1])
                if r[4] == 2 and len(out) < 5 and r[5] in last and r[5] not in names:
                    out.append(last[r[5]][1])
                    names.append(r[5])
        assert got[q] == out
    with pytest.raises(ValueError):
        hierarchy.selected("nearest", {})


def test_lists(spark):
    texts = ["1. a", "2) b", "x", "• p", "(3) c", "• q", "5. no", "b. stray", "a) one", "b) two", "1. again", "- dash"]
    df = spark.createDataFrame([(1, i // 5, i, x) for i, x in enumerate(texts)], "doc_id long, page long, seq long, text string")
    assert sorted((r.list, r.item, r.seq) for r in blocks.labelled_lists(df).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 4), (2, 1, 3), (2, 2, 5), (3, 1, 8), (3, 2, 9)]


def test_levels(spark):
    rows = [("heading", 1, None, None), ("list", None, "•", None), ("list", None, "1", None), ("list", None, "•", None), ("table", None, "t", None), ("list", None, "1", None), ("table", None, "u", 4), ("heading", 1, None, None), ("text", None, None, None)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, seq long, type string, heading_level int, style string, linked long")
    assert [r.level for r in blocks.levels(df).orderBy("seq").collect()] == ["Doctitle", "1", "2", "1", "2", "3", "2", "Subtitle"]


def test_page_edges(spark):
    rows = []
    for page in range(6):
        rows += [(1, page, 0, "text", 50.0, 800.0, 200.0, 810.0, f"Page {page + 4}", 9.0), (1, page, 1, "text", 50.0, 785.0, 200.0, 795.0, "Odd" if page % 2 else "Even", 9.0), (1, page, 2, "text", 50.0, 700.0, 200.0, 710.0, "Body starts", 9.0), (1, page, 3, "text", 50.0, 30.0, 90.0, 40.0, f"note {page * page}", 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, page long, seq long, kind string, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
    head = {(r.page, r.seq) for r in blocks.page_edges(df, F.lit(842.0)).collect()}
    assert head == {(p, s) for p in range(6) for s in (0, 1)}  # the body line stands apart
    assert {(r.page, r.seq) for r in blocks.page_edges(df, F.lit(842.0), top=False).collect()} == {(0, 3), (1, 3)}  # 0 and 1 follow each other


def docx(paragraphs):
    out, w = io.BytesIO(), "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>é</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_loaders(spark, tmp_path):
    given = {"a.txt": "héllo".encode(), "b.HTML": b"<p>x<script>no</script></p><p>y &amp; z</p>", "c.docx": docx(["one", "two"]), "d.docx": b"broken", "e.pdf": b"%PDF-1", "f.xlsx": b"?", "g.md": b"bad \xff byte"}
    for name, body in given.items():
        (tmp_path / name).write_bytes(body)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    got = {r.name: (r.loader, r.text) for r in files.load_documents(spark, str(tmp_path), lambda b: f"{len(b)} bytes").select(name, "loader", "text").collect()}
    assert got == {"a.txt": ("text", "héllo"), "b.HTML": ("html", "x y & z"), "c.docx": ("docx", "one\té\ntwo\té"), "d.docx": ("docx", None), "e.pdf": ("pdf", "6 bytes"), "f.xlsx": (None, None), "g.md": ("text", "bad  byte")}
    with pytest.raises(Exception, match="unsupported document format: .xlsx"):
        files.required(files.load_documents(spark, str(tmp_path))).collect()
    assert {r.path.rpartition("/")[2] for r in files.seeded(spark, str(tmp_path), "a.txt", "x").collect()} == set(given)
    assert files.seeded(spark, str(tmp_path), "default.txt", "x").filter("text = 'x'").count() == 1
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.load_jsonl(spark, str(tmp_path / "rows.jsonl"), "a long").filter("a is not null").orderBy("a").collect()] == [1, 2]


def test_stream_of_jobs(spark, tmp_path):
    rows = [("url", f"f{i}", ".md", f"h{i % 3}", 0, datetime(2024, 1, 1, 0, i)) for i in range(9)]
    spark.createDataFrame(rows, rates.JOB).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rates.JOB).json(str(tmp_path / "in"))
    query = rates.jobs(stream).writeStream.format("memory").queryName("jobs").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.file_hash for r in spark.table("jobs").collect()) == ["h0", "h1", "h2"]


def test_numbers_by_block(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id * 7 % 1000 as v")
    got = operations.numbered(rows, "k", "v", block=50).collect()
    for k in range(3):
        own = sorted((r.v, r.number) for r in got if r.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_script_and_html():
    assert structure.html_text("<div>a<style>p{}</style><noscript>n</noscript> <b>b</b>&lt;</div>") == "a b <"


def test_registries_and_options(spark):
    from docuflux.operators import providers

    assert providers.EMBEDDERS.make(" Test ") and providers.RERANKERS.make("none")
    with pytest.raises(ValueError, match="unknown embedder"):
        providers.EMBEDDERS.make("other")
    got = providers.Options.from_text("--chunk-size=300", "sanitize", "pages=1-3", "furniture=false")
    assert (got.chunk_size, got.sanitize, got.pages, got.furniture, got.parser) == (300, True, "1-3", False, "auto")
    with pytest.raises(ValueError, match="unknown option"):
        providers.Options.from_text("colour=red")
    said = spark.createDataFrame([("when do gates open", "The park is large. All gates open at nine. Dogs stay out.")], "q string, c string")
    assert said.select(providers.MODELS.make("fake")(F.col("q"), F.col("c")).alias("a")).first().a == "All gates open at nine."


def test_queue_retries_until_done(spark, tmp_path):
    from docuflux.streaming import queue

    rows = [(f"j{i}", "url", name, ".md", f"h{i}", 0, datetime(2024, 1, 1, 0, 0, i)) for i, name in enumerate(["good", "flaky", "bad", "wrong", "good"])]
    folder, results = str(tmp_path / "jobs"), str(tmp_path / "results")
    spark.createDataFrame(rows, queue.JOB).coalesce(1).write.json(folder)

    def work(jobs):
        ok = (F.col("file_name") == "good") | ((F.col("file_name") == "flaky") & (F.col("attempts") == 1))
        return jobs.withColumns({"ok": ok, "again": F.col("file_name") != "wrong"})

    queue.run(spark, folder, work, results, str(tmp_path / "checkpoint"))
    got = {r.job: (r.file_name, r.status, r.attempts) for r in queue.outcome(spark, results).collect()}
    assert got == {"j0": ("good", "done", 1), "j1": ("flaky", "done", 2), "j2": ("bad", "failed", 3), "j3": ("wrong", "failed", 1), "j4": ("good", "skipped", 0)}
