"""Edge cases and brute-force versions of the training-data operators."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docuflux.llm import bpe, decontam, jaccard_join, licenses, linededup, quality, queries, secrets, sharding, toxicity, warc

from ..compare import TINY, same

EDGE = [(1, "", "en", 9), (2, None, "de", 9), (3, "one", None, 9), (4, "one", "en", 9), (4, "one", "en", 9), (None, "one two three four", "en", 9), (5, "x " * 30000, "fr", 9), (6, "é\n\n#*$", "en", 9)]
SCHEMA = "doc_id long, text string, lang string, n long"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(queries.queries()[name](spark, TINY), queries.oracle_sql()[name])


def components(texts, k, a, b):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in combinations(sets, 2):
        both = len(sets[u] & sets[v])
        if both and b * both >= a * (len(sets[u]) + len(sets[v]) - both):
            x, y = sorted((find(u), find(v)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    made = {}
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([4, 9, 19, 40, 150, 700]))]
        for copy in range(12):
            own = list(text)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            made[base * 100 + copy] = " ".join(own[: len(own) - rng.randrange(2)])
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    for k, a, b in ((3, 90, 100), (1, 70, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, a, b).collect()}
        assert got == components(made, k, a, b)


def test_jaccard_edges(spark, edge, none):
    got = jaccard_join.jaccard_components(edge, 3, 90, 100).collect()
    want = {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 6)}
    assert len(got) == len(EDGE)
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id else (2, None))
    assert jaccard_join.jaccard_components(none).count() == 0


def repeated(more):
    made = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abde"}
    near = lambda c: made[c] + " end"
    rows = [(7, made["a"]), (7, made["a"]), (8, near("a")), (6, made["d"]), (5, made["d"]), (9, made["b"]), (10, near("b"))]
    return rows + [(9, made["e"]), (11, near("e"))] * more


def test_jaccard_repeated_rows(spark):
    got = jaccard_join.jaccard_components(spark.createDataFrame(repeated(0), "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (6, 5), (7, 7), (7, 7), (8, 7), (9, 9), (10, 9)]


def test_jaccard_one_id_two_texts(spark):
    got = jaccard_join.jaccard_components(spark.createDataFrame(repeated(1), "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (6, 5), (7, 7), (7, 7), (8, 7), (9, 9), (9, 9), (10, 9), (11, 9)]


def test_near_duplicates_removed(spark, edge, none):
    df = spark.createDataFrame(repeated(1), "doc_id long, text string").withColumns({"gone_id": F.lit(1), "mark": F.lit(2), "row": F.lit(3), "a.b": F.lit(4)})
    out = jaccard_join.near_duplicates_removed(df.repartition(5), 3, 90, 100)
    assert out.columns == df.columns
    # 9 stands for two unrelated texts, each the first of its group
    assert sorted((r.doc_id, r.text[0]) for r in out.collect()) == [(5, "d"), (7, "a"), (9, "b"), (9, "e")]
    left = sorted((str(r.doc_id), str(r.text)[:4]) for r in jaccard_join.near_duplicates_removed(edge, 3, 90, 100).collect())
    assert left == [("1", ""), ("2", "None"), ("3", "one"), ("5", "x x "), ("6", "é\n\n#"), ("None", "one ")]
    assert jaccard_join.near_duplicates_removed(none).count() == 0


def test_jaccard_low_limits(spark):
    made = {1: "x", 2: "x y", 3: "x y z", 4: "y z q r", 5: "m n", 6: "m n o p", 7: "s t u v w", 8: "s t u"}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    for a, b in ((1, 2), (2, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 1, a, b).collect()}
        assert got == components(made, 1, a, b)


def test_jaccard_large_group(spark):
    """A list of hundreds of near copies with few to many edits, dealt over many partitions."""
    rng = random.Random(8)
    base, made = [f"b{i}" for i in range(120)], {}
    for i in range(500):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        made[i] = " ".join(own)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 90, 100).collect()}
    assert got == components(made, 3, 90, 100)


def test_sharding(spark, edge, none):
    rows = sharding.sharded(edge, [1.0] * 4).collect()
    assert len(rows) == len(EDGE)
    assert {r.text_crc32 for r in rows if r.doc_id == 3} == {zlib.crc32(b"one")}
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "1 as shard")
    got = sharding.sharded(docs, [1.0, 2.0, 0.0, 1.0]).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert not by[2] and 1300 < len(by[1]) < 1700
    assert all(r.grown_shard in (r.shard, 4) for r in got) and any(r.grown_shard == 4 for r in got)
    assert sharding.sharded(none, [1.0]).count() == 0


def test_secrets(spark, edge, none):
    assert secrets.secrets(edge).count() == len(EDGE) and secrets.secrets(none).count() == 0
    body = "ghp_" + "z" * 30
    digits, left = "", zlib.crc32(body[4:].encode())
    for _ in range(6):
        digits, left = chr(secrets.BASE62[left % 62]) + digits, left // 62
    text = f'é "password": "hunter22" api_key=abc AKIA{"A" * 16} {"ab" * 12} {body}{digits} {body}000000'
    got = secrets.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), redact=True).first()
    assert (got.n_assign, got.n_access, got.n_hex) == (1, 1, 1)
    assert [s.split(":")[0] for s in got.spans.split(",")] == ["assign", "access", "hex", "checked"]
    assert "hunter22" not in got.clean and got.clean.startswith('é "[ASSIGN]')
    odd = edge.withColumns({"_row": F.lit(1), "clean": F.lit(2), "n_chars": F.length("text")})
    assert secrets.without_secrets(odd).columns == odd.columns and secrets.without_secrets(odd).count() == len(EDGE)


def test_secrets_against_plain_patterns(spark, texts):
    made = dict(texts)
    made[10001] = "token=abcdef token: 'x' SECRET : \"q1w2e3r4\" api_key=a.b-c/d+e= AKIA" + "Q" * 15 + " AKIA" + "Q" * 16 + "x " + "a1" * 11 + " " + "0f" * 13 + "é tokentoken = 123456"
    made[10002] = "passwordpassword=short password=\n" + "apikey='" + "z" * 3000 + "' passwd:=abc"
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    some = 0
    for i, text in made.items():
        spans = []
        for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
            spans += [(m.start(), 0, "assign", m.end())] if len(m[1]) >= 6 else []
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        plain, r = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)), got[i]
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in secrets.BASE)
        some += bool(spans)
    assert some >= 2


def test_bpe_round_trip(spark, edge, none, texts):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(queries.TOKENIZER)
    with open(queries.TOKENIZER) as f:
        codec = bpe.Codec(f.read())
    for text in [*texts.values(), "", "<|endoftext|> Hi<|startoftext|>", "ΑΣ İ ½² \x1c a\x85b 日本 🙂 don't 'S", "a" * 3000]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        assert codec.decode(codec.encode(text)).decode() == theirs.decode(ids, skip_special_tokens=False)
    got = bpe.encoded(edge, queries.TOKENIZER).filter("doc_id = 2").first()
    assert got.n_tokens == 0 and got.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encoded(none, queries.TOKENIZER).count() == 0


def test_line_dedup(spark, edge, none):
    passage = "One two three four five six seven, eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen: eighteen nineteen twenty twenty-one twenty-two! A b c."
    short = "\n".join(f"w{i}" for i in range(40))
    rows = [(2, f"Own words here, é. {passage} End", 1), (1, passage, 2), (3, None, 3), (4, "", 4), (5, "intro\n" + short, 5), (6, f"é\n{short}\nx y", 6), (7, "Or q r s. " + passage[:60], 7), (None, passage, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = {r.doc_id: (r.n_removed, r.removed_words, r.kept_doc_ids) for r in linededup.removals(df).collect()}
    # 7 repeats ten words only; in 5 and 6 no line is long enough alone
    assert got == {2: (1, 25, [1]), 6: (1, 40, [5]), None: (1, 25, [1])}
    for given in (df, df.repartition(4, "row")):
        out = linededup.without_repeats(given)
        assert out.columns == ["doc_id", "text", "row", "removed_spans"]
        left = {r.row: r.text for r in out.collect()}
        assert left[2] == passage and left[1] == "Own words here, é.  End" and left[3] is None and left[8] == "" and left[6] == "é\n\nx y"
        assert left[5] == "intro\n" + short and left[7].endswith(passage[:60])
    assert linededup.removals(none).count() == 0
    assert linededup.removals(edge).count() == 0


def test_line_dedup_keeps_first_occurrences(spark):
    """A run over the end of one passage and the beginning of another is first in doc 1, so that doc 1
    keeps it although the second passage is first in doc 0; whatever is named as keeper holds the run."""
    sentence = lambda k, n: " ".join(f"s{k}w{i}" for i in range(n)) + "."
    a, b = [sentence(k, 6) for k in range(6)], [sentence(k, 6) for k in range(10, 18)]
    rows = [(0, " ".join(b)), (1, " ".join(a + b)), (2, " ".join(a + b[:1]))]
    out = {r.doc_id: r for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1]
    # the runs of a's last sentence reach over b's first two: as far as doc 2 has them they are kept
    assert out[1].text == " ".join(a + b[:1]) + " " * out[1].text.endswith(" ")
    assert out[2].text == "" and [len(out[i].removed_spans) for i in range(3)] == [0, 1, 1]
    got = {r.doc_id: r.kept_doc_ids for r in linededup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [0], 2: [1]}


def test_line_dedup_by_plain_cover(spark, texts):
    """Every word of a removed stretch is in a repeat, and none in a first occurrence, of runs found by plain loops."""
    first, runs = {}, {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        low = data.lower().split()
        runs[doc] = [(at, n, tuple(low[at : at + n])) for at, n in zip(*(x.tolist() for x in linededup.runs(data, linededup.MIN_WORDS)[:2]), strict=True)]
        for at, _, words in runs[doc]:
            first.setdefault(words, (doc, at, []))[2].append((doc, at))
    want = {}
    for doc, own in runs.items():
        held, gone = set(), set()
        for at, n, words in own:
            keeper, place, seen = first[words]
            if len(seen) > 1 and (keeper, place) == (doc, at):
                held |= set(range(at, at + n))
            elif keeper != doc or at >= place + n:
                gone |= set(range(at, at + n))
        cut, size, count = sorted(gone - held), 0, [0, 0]
        for i, w in enumerate(cut):
            size = size + 1 if i and cut[i - 1] == w - 1 else 1
            if i + 1 == len(cut) or cut[i + 1] != w + 1:
                count = [count[0] + 1, count[1] + size] if size >= linededup.LEAST else count
        if count[0]:
            want[doc] = tuple(count)
    got = {r.doc_id: (r.n_removed, r.removed_words) for r in linededup.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_finds_long_passages(spark, texts):
    """Documents with a window of 51 words that an earlier one has, but for passages that are one clause in another line."""
    first, want = {}, set()
    for doc in sorted(texts):
        w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", texts[doc] or "")]
        for i in range(len(w) - 50):
            if first.setdefault(tuple(w[i : i + 51]), doc) != doc:
                want.add(doc)
    got = {r.doc_id for r in linededup.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert want and len(want & got) >= 0.95 * len(want)


def test_quality(spark, edge, none, texts):
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    got = {r.doc_id: r for r in quality.rules(spark.read.parquet(f"{TINY}/documents.parquet"), labels).collect()}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        counts = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
        covered = {j + d for j, g in enumerate(grams) if counts[g] > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    got = quality.rules(edge, labels).collect()
    assert len(got) == len(EDGE) and [r.n_words for r in got if r.doc_id == 5] == [30000] and all(r.base_failed and not r.kept for r in got)
    assert quality.rules(none, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(k, n) for n in (0, 1, 30, 700) for k in (0, 1, 3) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.lower_tail("k", "n", 0.02).alias("p"))
    for r in df.collect():
        want = 1.0 if not r.n or r.k > r.n * 0.02 else sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - want) < 1e-9


def test_quality_controls_risk(spark):
    """Thresholds against the same by brute force; symbols mark bad rows, word length errs too often."""
    from math import comb

    rng, rows, labels = random.Random(3), [], []
    for i in range(3000):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(10**6)}" + ("longlonglong" if rng.random() < (0.9 if bad else 0.04) * (i % 2) else "") for _ in range(60)]
        long_ = i % 2 and rng.random() < (0.9 if bad else 0.04)
        words = [w + "longlonglonglong" * bool(long_) for w in words]
        rows.append((i, " ".join(words) + (" #" * rng.choice([4, 20]) if bad and rng.random() < 0.8 else ""), "ab"[i % 2]))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.features(docs)
    found = spark.createDataFrame(found.collect(), found.schema)
    mark = dict(labels)
    got = {(r.stratum, r.rule): (r.cutoff, r.k, r.n) for r in quality.thresholds(found, marks).collect()}
    order = [(i, rule, c) for i, (rule, cs) in enumerate(quality.RULES.items()) for c in cs]
    want = {}
    for stratum in "ab":
        own = [(r, mark[r.doc_id]) for r in found.collect() if r.stratum == stratum and not r.base_failed]
        half = {side: [(r, q) for r, q in own if (hashlib.md5(str(r.doc_id).encode()).hexdigest()[0] < "8") == side] for side in (True, False)}
        steps = []
        for i, rule, c in order:
            good, bad = ([r[rule] >= c for r, q in half[False] if q == x] for x in (1, 0))
            if sum(bad) and sum(bad) * len(good) >= 3 * sum(good) * len(bad):
                steps.append((sum(good) / len(good), -sum(bad), i, -c, rule))
        holdout, policy = [r for r, q in half[True] if q == 1], []
        for *_, minus, rule in sorted(steps):
            policy.append((rule, -minus))
            n, k = len(holdout), sum(any(r[x] >= y for x, y in policy) for r in holdout)
            if k > n * 0.01 or sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) > 0.05 / 2:
                break
            cutoff = min(y for x, y in policy if x == rule)
            want[stratum, rule] = (cutoff, max(k, want.get((stratum, rule), (0, 0))[1]), n)
    assert got == want and ("a", "symbol_permille") in got
    verdicts = {r.doc_id: r for r in quality.rules(docs, marks).collect()}
    for r in found.collect():
        by = [rule for rule in quality.RULES if (r.stratum, rule) in want and r[rule] >= want[r.stratum, rule][0]]
        assert verdicts[r.doc_id].rejected_by == ",".join(by) and verdicts[r.doc_id].kept == (not by and not r.base_failed)
    assert quality.rules(docs, marks.limit(0)).filter("not base_failed and not kept").count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * i) for i in range(300)] + [(None, None, None)], "page_id long, url string, html string")
    a = warc.records(pages)
    hurt = a.filter("id <> 299").selectExpr("volume", "id", "case when id = 7 then concat(bytes, X'00') else bytes end as bytes")
    leaves, roots, _ = warc.audit(a, hurt)
    by = {}
    for r in leaves.collect():
        by.setdefault(r.status, set()).add(r.id)
    assert 7 in by["corrupt"] and by["missing"] == {299} and {0, 1, 6} <= by["ok"] and "extra" not in by
    same_leaves, same_roots, none = warc.audit(a, a)
    assert {r.status for r in same_leaves.collect()} == {"ok"} and same_roots.filter("root <> replica_root").count() == 0 and none.isEmpty()


def test_warc_ranges(spark):
    """Nodes bind the lengths and numbers of their ranges; ranges that differ are given on both sides."""
    pages = spark.createDataFrame([(i, "u", "x" * (i % 9)) for i in range(40)], "page_id long, url string, html string")
    a = warc.records(pages)
    b = a.filter("id not in (10, 11, 39)").selectExpr("volume", "id", "case when id in (12, 30) then concat(bytes, X'00') else bytes end as bytes")
    size = {r.id: len(r.bytes) for r in a.collect()}
    there = {r.id: len(r.bytes) for r in b.collect()}
    before = lambda sizes, i: sum(n for j, n in sizes.items() if j < i)
    leaves, roots, ranges = warc.audit(a, b)
    got = sorted(tuple(r) for r in ranges.select("start", "end", "n", "replica_start", "replica_end", "replica_n").collect())
    want = [(before(size, 10), before(size, 13), 3, before(there, 12), before(there, 13), 1), (before(size, 30), before(size, 31), 1, before(there, 30), before(there, 31), 1), (before(size, 39), before(size, 40), 1, None, None, 0)]
    assert got == want and roots.count() == 1
    # a node differs as soon as a child's range has another length, though all digests of records were equal
    one = spark.createDataFrame([(0, 0, "d", 5, 1)], "volume long, place long, node string, length long, n long")
    digest = lambda rows: warc.over(rows, F.col("place"), "place").first().node
    assert len({digest(one), digest(one.withColumn("length", F.lit(6).cast("long"))), digest(one.withColumn("n", F.lit(2).cast("long")))}) == 3


def test_warc_empty_replicas(spark):
    rows = [(1, "u", "a"), (2, None, None), (None, "v", "b"), (2, None, None)]
    pages = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "page_id long, url string, html string, id string, n int, volume int")
    a, empty = warc.records(pages), warc.records(pages.limit(0))
    for mine, theirs, status in ((a, empty, "missing"), (empty, a, "extra")):
        leaves, roots, ranges = warc.audit(mine, theirs)
        assert [r.status for r in leaves.collect()] == [status] * 4 and {(r.n, r.replica_n) for r in ranges.collect()} in ({(3, 0), (1, 0)}, {(0, 3), (0, 1)})
        assert all((r.root is None) != (r.replica_root is None) for r in roots.collect())
    assert all(x.count() == 0 for x in warc.audit(empty, empty))


def test_warc_losses_stay_local(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i % 50)) for i in range(5000)] + [(9, "u", "a"), (9, "u", "a"), (9, "v", "b")], "page_id long, url string, html string")
    a = warc.records(pages)
    longer = "case when id in (70, 4500) then concat(bytes, X'0000') else bytes end as bytes"
    extra = warc.records(spark.createDataFrame([(6000, "n", "n")], pages.schema))
    b = a.filter("id not in (0, 40, 41, 3000)").filter("not (id = 9 and instr(cast(bytes as string), 'URI: v') > 0)").selectExpr("volume", "id", longer).union(extra)
    found = warc.audit(a, b)[0].collect()
    by = {s: sorted(r.id for r in found if r.status == s) for s in ("corrupt", "missing", "extra")}
    assert by == {"corrupt": [70, 4500], "missing": [0, 9, 40, 41, 3000], "extra": [6000]}
    assert len(found) == 5004 and sum(r.status == "ok" for r in found) == 5003 - 7
    # shifts against both layouts
    lay = lambda d: sorted((r.id, r.record_sha256, r.offset) for r in warc.leaves(d).collect())
    there = dict(((i, h), o) for i, h, o in lay(b) if i != 9)
    for r in found:
        if r.status == "ok" and r.id != 9:
            assert r.offset + r["shift"] == there[r.id, r.record_sha256]
        assert (r["shift"] is None) == (r.status in ("missing", "extra"))


def test_warc_query_finds_the_stated_damage(spark):
    folder = TINY.replace("sf0.001", "sf0.01")
    fate = {r.page_id: int(hashlib.md5(str(r.page_id).encode()).hexdigest()[:7], 16) % 97 for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id").collect()}
    want = {i: {0: "corrupt", 1: "missing"}.get(f, "ok") for i, f in fate.items()}
    assert {r.page_id: r.status for r in queries.op8_warc_fixity(spark, folder).collect()} == want and {"corrupt", "missing"} <= set(want.values())


def test_decontamination_blocks(spark, edge, none):
    bench = spark.read.parquet(f"{TINY}/benchmark.parquet")
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    key = lambda d: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), str(r.spans)) for r in d.collect())
    assert key(decontam.contamination(docs, bench)) == key(decontam.contamination(docs, bench, block_words=500))
    short = spark.createDataFrame([(1, "one"), (2, "one two"), (3, None), (4, "")], "item_id long, text string")
    for r in decontam.contamination(edge, short).collect():
        items = [("1", "one"), ("2", "one two")]
        text = next(t for i, t, *_ in EDGE if i == r.doc_id)
        n_words, n_hit, n_items, _ = decontam.expected(text, items)
        assert (r.n_words, r.n_hit, len(r["items"])) == (n_words, n_hit, n_items)
    assert decontam.contamination(none, bench).count() == 0
    unnamed = spark.createDataFrame([(None, "one\ntwo,THREE"), (7, "\n")], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in decontam.contamination(edge, unnamed).collect() if r.doc_id is None] == [(3, [])]
    odd = edge.withColumns({"_row": F.lit(1), "_text_key": F.lit(2), "row": F.lit(3), "a.b": F.lit(4)})
    left = decontam.decontaminated(odd, short)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "5", "6"]
    long_item = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(500)))], "item_id long, text string")
    own = spark.createDataFrame([(i, " ".join(f"v{j}" for j in range(i, i + 10))) for i in range(491)] + [(600, "v1 v2")], "doc_id long, text string")
    for words in (10**6, 400):
        assert decontam.contamination(own.repartition(4), long_item, block_words=words).filter("n_hit = 10").count() == 491
        assert [r.doc_id for r in decontam.decontaminated(own, long_item, block_words=words).collect()] == [600]


def test_licenses(spark, edge, none):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "NONINFRINGEMENT" in t)
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0-or-later")
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        (1, "x\nLICENSED under the apache license; version 2.0\ny"), (2, "Released under the MIT License!"), (3, None), (4, "_Released_under_the_MIT_License_"),
        (5, "Copyright 2024 Foo Inc. Licensed under the Apache License, Version 2.0. See NOTICE."), (6, "# a tool\n" * 9 + wrap(gpl, 7) + "\nmore lines\n" * 9),
        (7, "about\n" * 20 + wrap(mit, 9) + "\nint main" * 300), (8, "words of no licence " * 50),
        (9, wrap(" ".join([mit] * 12), 9)),  # many words, few distinct bigrams
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))
    want = {1: "Apache-2.0", 2: "MIT", 3: None, 4: "MIT", 5: "Apache-2.0", 6: "GPL-3.0-or-later", 7: "MIT", 8: None, 9: "MIT"}
    for given in (df, df.repartition(4)):
        got = licenses.scan(given).collect()
        assert {r.doc_id: r.best_license for r in got} == want
        assert all((r.n_units + r.n_windows > 0) == (r.best_license is not None) for r in got)
        assert next(r for r in got if r.doc_id == 7).best_dice == 1.0
    # the same by brute force, without any pruning
    def dice(a, b):
        x, y = set(licenses.grams_of(a)), set(licenses.grams_of(b))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0

    for i, text in rows:
        units = [licenses.words_of(x) for x in (text or "").split("\n")]
        units += [sum(units, [])] if len(units) > 1 else []
        best = [max((dice(u, licenses.words_of(t)), -n, name) for n, (name, t) in enumerate(licenses.TEMPLATES)) for u in units]
        assert next(r.n_units for r in got if r.doc_id == i) == sum(b[0] >= licenses.LEAST for b in best)
    assert [(r.doc_id, r.n_units, r.licenses) for r in licenses.scan(edge).collect()] == [(i, 0, "") for i, *_ in EDGE]
    assert licenses.scan(none).count() == 0


def test_toxicity_learns():
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(700):
        text, bad = [rng.choice(words) for _ in range(rng.randrange(20, 200))], i % 5 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["blorg", "snarfy"]) + rng.choice(["", "en", "ing"])
        rows.append((" ".join(text).encode(), int(bad)))
    model = toxicity.Model([t for t, _ in rows[:500]], [y for _, y in rows[:500]])
    scores, y = toxicity.Scorer(model).scores([t for t, _ in rows[500:]]), np.array([y for _, y in rows[500:]])
    assert ((scores >= 0.5) == y).mean() > 0.95
    assert np.isfinite(toxicity.Scorer(model).scores([None, b"", b"word1"])).all()
    assert toxicity.Scorer(toxicity.Model([], [])).scores([b"a"]).tolist() == [0.0]


def test_toxicity_steps_do_not_depend_on_rows(monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity.Model, "_learn", lambda *a: taken.append(a[-1]))
    counts = []
    for n in (10, 100, 400):
        taken.clear()
        toxicity.Model([f"word{i % 7} other{i}".encode() for i in range(n)], [int(i % 5 == 0) for i in range(n)])
        counts.append(len(taken))
        assert taken == list(range(1, len(taken) + 1))
    assert len(set(counts)) == 1 and counts[0] >= 120


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    words = toxicity.Words([b"a", b"bcd", b"efghijk"])
    net, ids, y = toxicity.Network(3), np.array([[1, 2, 0], [3, 1, 2]]).T, np.array([1.0, 0.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    stats = rng.standard_normal((3, toxicity.STATS))

    def loss():
        logits = net.forward(net.projected(net.inputs(words, stats)), ids)[0]
        return float(np.mean(np.logaddexp(0, logits) - y * logits))

    grads = net.gradients(words, net.inputs(words, stats), ids, y)
    for k in ("wf", "ub", "a", "av", "o", "bf"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - grads[k][at]) < 2e-3


def test_windows_cover():
    for n in (0, 1, 64, 65, 112, 113, 500):
        spans = toxicity.windows_of(n)
        assert set().union(*[range(a, b) for a, b in spans]) == set(range(n))


def test_toxicity_rows(spark, edge, none):
    docs, labels = spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/labels.parquet")
    odd = edge.withColumns({"_row": F.lit(1), "score": F.lit(2), "toxic": F.lit(3)})
    out = toxicity.without_toxic(odd, labels.limit(0))
    assert out.columns == odd.columns and out.count() == len(EDGE)  # without labels nothing is rejected
    got = toxicity.scored(edge, labels.unionByName(labels.limit(1).withColumn("toxic", F.lit(None).cast("int")), allowMissingColumns=True)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.scored(none, labels).count() == 0
    assert docs.count() == toxicity.scored(docs, labels).count()


def test_pipeline(spark, texts):
    """Each stage by brute force on what the stage before it kept."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    before = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, TINY)
        assert rows.columns == docs.columns, name
        out = {r.doc_id: r.text for r in rows.collect()}
        if name == "near_duplicates":
            found = components(before, 5, 80, 100)
            assert set(out) == {i for i, (n, c) in found.items() if c == i or not n}
        elif name == "decontamination":
            assert set(out) == {i for i, t in before.items() if not decontam.expected(t, bench)[1]}
        elif name == "secrets":
            assert set(out) == set(before)
            words = secrets.automaton()
            assert not any(secrets.scan((t or "").encode(), words) for t in out.values())
            assert all(out[i] == before[i] for i in out if not secrets.scan((before[i] or "").encode(), words))
        assert name == "secrets" or all(out[i] == before.get(i, texts[i]) for i in out)
        docs, before = spark.createDataFrame(rows.collect(), docs.schema), out
    theirs = Tokenizer.from_file(queries.TOKENIZER)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert {r.doc_id: list(r.ids) for r in last} == {i: theirs.encode(t, add_special_tokens=False).ids for i, t in before.items()}
