"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits,
then validation of checksums that a secret carries.

All patterns use ASCII classes only, so they run on UTF-8 bytes; offsets are turned into code
points for texts with hits. The keyword of hexadecimal runs is a run of one letter in a copy of
the text whose bytes are folded to two classes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, packed, text_slices

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
#: Tokens with a CRC-32 of their body in their last six base-62 digits: prefix, body, checksum.
CHECKED = {b"ghp_": 30, b"gho_": 30, b"ghu_": 30, b"ghs_": 30, b"ghr_": 30, b"npm_": 30}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TOKEN_BODY = re.compile(rb"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE = ("assign", "access", "hex")
#: Least lengths of what each base kind matches.
LEAST = {"assign": 6, "access": 20, "hex": 24}
FOLD = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))
RUN = b"h" * LEAST["hex"]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for prefix in CHECKED:
        found.add_word(prefix.decode(), ("checked", len(prefix)))
    found.make_automaton()
    return found


def checksum_ok(token: bytes) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of the body before them."""
    body, said = token[4:-6], 0
    for c in token[-6:]:
        said = said * 62 + BASE62.index(c)
    return said == zlib.crc32(body)


def scan(text: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind; base kinds leftmost, non-overlapping."""
    found: list[tuple[int, int, str]] = []
    done = {"assign": 0, "access": 0}
    hits = sorted((end + 1 - size, kind, size) for end, (kind, size) in words.iter(text.lower().decode("latin-1")))
    for start, kind, size in hits:
        if kind == "checked":
            if text[start : start + size] in CHECKED and (start == 0 or not text[start - 1 : start].isalnum()):
                m = TOKEN_BODY.match(text, start + size)
                if m and checksum_ok(text[start : m.end()]):
                    found.append((start, m.end(), "checked"))
            continue
        if start < done[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS).match(text, start)
        if m:
            done[kind] = m.end()
            if len(m[1] if kind == "assign" else m[0]) >= LEAST[kind]:
                found.append((start, m.end(), kind))
    folded = text.translate(FOLD)
    at = folded.find(RUN)
    while at >= 0:
        m = HEX.match(text, at)
        found.append((at, m.end(), "hex"))
        at = folded.find(RUN, m.end())
    order = (*BASE, "checked")
    return sorted(found, key=lambda x: (x[0], order.index(x[2])))


def code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with offsets counted in code points."""
    if not spans or len(text) == len(text.decode("utf-8", "replace")):
        return spans
    marks, at, count, place = sorted({x for s in spans for x in s[:2]}), 0, 0, {}
    for mark in marks:
        count += len(text[at:mark].decode("utf-8", "replace"))
        at, place[mark] = mark, count
    return [(place[a], place[b], kind) for a, b, kind in spans]


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _worker(redact: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch, texts in text_slices(batches, "text"):
            rows = []
            for text in texts:
                text = text or b""
                raw = scan(text, words)
                spans = code_points(text, raw)
                base = [s for s in spans if s[2] in BASE]
                kinds = [s[2] for s in base]
                clean = redacted(text, raw).decode("utf-8", "replace") if redact and raw else None
                rows.append((*[kinds.count(k) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), clean))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                [batch.schema.names[i] for i in keep] + ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean"],
            )

    return work


def redacted(text: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    """text with each stretch that spans cover replaced by the first one's kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"[{kind.upper()}]".encode()]
        at = b
    return b"".join([*out, text[at:]])


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean string"


def secrets(docs: DataFrame, redact: bool = False) -> DataFrame:
    """For each row of docs: doc_id, counts by base kind, base_sha256, spans, and with redact the
    text without its secrets in `clean` (null where there is none).

    docs: doc_id, text; further columns are ignored. Null and empty texts have no spans. Rows
    that repeat give a row each; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", F.encode("text", "UTF-8").alias("text")), _worker(redact), f"doc_id {kind}, {FOUND}")


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret in `text` replaced by its kind, and n_chars to match; all columns stay."""
    rows = packed(docs)
    out = arrow_map(rows, _worker(True), T.StructType([rows.schema["_row"], *T.StructType.fromDDL(FOUND)]))
    own = lambda c: F.col("_row").getField(c)
    columns = {c: own(c) for c in docs.columns} | {"text": F.coalesce("clean", own("text"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("clean").isNull(), own("n_chars")).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
