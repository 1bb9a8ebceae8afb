"""What a worker holds is bounded by settings, whatever its task's texts."""

from __future__ import annotations

import hashlib
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from docuflux.llm import bpe, queries, toxicity
from docuflux.llm.common import arrow_map, text_slices


def test_scorer_holds_bounded_memory():
    model = toxicity.Model([f"word{i % 7} other{i}".encode() for i in range(40)], [int(i % 7 == 0) for i in range(40)])
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)).encode() for i in range(260)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary())})
    scorer = toxicity.Scorer(model)
    tracemalloc.start()
    scored = sum(len(scorer.scores(part)) for _, part in text_slices(iter([batch]), "text"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored == len(texts)
    assert most < 90e6  # 200 MB and more when slices had 4 MB and 262,144 words were kept


def test_scores_do_not_depend_on_what_is_kept(monkeypatch):
    model = toxicity.Model([f"word{i % 7} other{i}".encode() for i in range(40)], [int(i % 7 == 0) for i in range(40)])
    texts = [" ".join(f"word{(i * j) % 11} other{i + j}" for j in range(90)).encode() for i in range(30)]
    once = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "KEPT", 10)
    scorer = toxicity.Scorer(model)
    apart = [x for i in range(0, 30, 3) for x in scorer.scores(texts[i : i + 3])]
    assert abs(once - apart).max() < 1e-5


def test_batches_are_small(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.lit("x" * 4096).alias("text"))
    sizes = arrow_map(rows, lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) < 6e6


def test_encoder_holds_bounded_memory():
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        spec = f.read()
    codec = bpe.Codec(spec)
    tracemalloc.start()
    for i in range(300):
        codec.encode(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}x,{chr(97 + j % 26)}{chr(97 + j // 26)}y" for j in range(500)))
    assert tracemalloc.get_traced_memory()[0] < 5e6  # 19 MB when stretches between white space were kept
    ids = codec.encode("one word more " * 100_000)
    tracemalloc.reset_peak()
    before, made = tracemalloc.get_traced_memory()[0], codec.digests(ids)
    assert tracemalloc.get_traced_memory()[1] - before < 5e6  # 50 MB when texts were gathered whole
    tracemalloc.stop()
    assert made == (hashlib.sha256(codec.decimal(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())


def test_encoder_gives_the_same_ids_in_parts(monkeypatch):
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    plain = "It's  the\tfirst_line\nof 12 (words), isn't it? naïve e\u0301 " * 9
    texts = [plain, plain + "ΣΑΣ \u201cquoted\u201d ½ " * 5, "x" * 200 + " " + "y" * 200, " \n ", "", "a\x1cb c " + plain]
    whole = [codec.encode(t).tolist() for t in texts]
    by_words = [[i for w in codec.pieces(t) for i in codec.encode_word(w)] for t in texts]
    digests = [codec.digests(codec.encode(t)) for t in texts]
    monkeypatch.setattr(bpe, "SPAN", 7)
    monkeypatch.setattr(bpe, "GATHERED", 3)
    assert [codec.encode(t).tolist() for t in texts] == whole == by_words
    assert [codec.digests(codec.encode(t)) for t in texts] == digests


def test_encoded_keeps_ids(spark):
    rows = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "doc_id long, text string")
    kept = {r.doc_id: r for r in bpe.encoded(rows, queries.TOKENIZER, keep_ids=True).collect()}
    assert len(kept[1].ids) == kept[1].n_tokens == 2 and kept[2].ids == kept[3].ids == []
    assert all(r.ids is None for r in bpe.encoded(rows, queries.TOKENIZER).collect())
