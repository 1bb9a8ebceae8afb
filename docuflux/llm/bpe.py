"""BPE encoding and decoding for a vocabulary with word ends.

A word is encoded by backtracking: an Aho-Corasick automaton lists the tokens that occur in it,
the longest one that starts at the present place is tried first, and a token may follow another
only if the pair table says that merging their joined text gives exactly these two. Places that
were found dead are not tried again, so the work is linear in the word. The result equals that
of applying the merges by rank. The table fills as pairs are met. Decoding gathers token texts
from one byte string by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices

#: Entries of a worker's memories of pairs, words, and stretches between white space with unlike characters; longer ones are not remembered.
KEPT, WORDS, CHUNKS, LONG = 1 << 18, 1 << 18, 1 << 16, 64
#: Characters of a text that are cut into words at a time (at white space), and tokens whose texts are gathered at a time.
SPAN, GATHERED = 1 << 16, 1 << 14
OTHER_SPACE = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[ \t\n\r]")
#: Fixed pattern of the public tokenizer.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for texts without the characters of UNLIKE, where \w and \d agree with \p{L} and \p{N}.
PLAIN = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")
UNLIKE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


def offset_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte string, and where each begins."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def gathered(ids: np.ndarray, blob: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """The ids' texts one after another, without the last byte, a space; in parts."""
    for at in range(0, len(ids), GATHERED):
        part = ids[at : at + GATHERED]
        starts = offsets[part]
        lengths = offsets[part + 1] - starts
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        found = blob[np.arange(len(shift)) + shift].tobytes()
        yield found if at + GATHERED < len(ids) else found[:-1]


def digest(parts: Iterator[bytes]) -> str:
    """SHA-256 of the parts joined."""
    out = hashlib.sha256()
    for part in parts:
        out.update(part)
    return out.hexdigest()


def spans(text: str) -> Iterator[str]:
    """text in parts of SPAN characters or a little more, each but the first beginning with white space."""
    at = 0
    while len(text) - at > SPAN and (cut := BLANK.search(text, at + SPAN)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class Codec:
    """Encoder and decoder of one tokenizer file's content (JSON text)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.end = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        # tokens of merges are the vocabulary's own strings, not copies
        own = {name: name for name in self.vocabulary}
        merges = model.pop("merges")
        merges.reverse()
        self.rank: dict[tuple[str, ...], int] = {}
        for i in range(len(merges)):
            m = merges.pop()
            self.rank[tuple(own.get(t, t) for t in (m if isinstance(m, list) else m.split(" ")))] = i
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        table = [b""] * (max([*self.vocabulary.values(), *self.special.values()]) + 1)
        for names in (self.vocabulary, self.special):
            for name, i in names.items():
                table[i] = name.encode() + b" "
        self.blob, self.offsets = offset_table(table)
        self.digits, self.digit_offsets = offset_table([b"%d " % i for i in range(len(table))])
        self.letters = byte_letters()
        self.letter_of = dict(enumerate(self.letters))
        # the last letter of a word is a symbol of its own, here one plane up
        self.last = {c: chr(0x10000 + ord(c)) for c in self.letters}
        self.automaton = ahocorasick.Automaton()
        self.text_of = [""] * len(table)
        for name, i in self.vocabulary.items():
            inner = name.removesuffix(self.end)
            folded = inner if inner == name or not inner else inner[:-1] + self.last[inner[-1]]
            self.text_of[i] = folded
            self.automaton.add_word(folded, i)
        self.folded = {self.text_of[i]: i for i in self.vocabulary.values()}
        self.sizes = array("i", map(len, self.text_of))
        self.widest = max(self.sizes)
        self.next_shorter: dict[int, int | None] = {}
        self.automaton.make_automaton()
        self.unlast = {v: k + self.end for k, v in self.last.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges by rank, lowest first: the definition, used for short strings only."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            pair = symbols[best], symbols[best + 1]
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            text = self.text_of[a] + self.text_of[b]
            got = self.merged([self.unlast.get(c, c) for c in text])
            known = self.pairs[a, b] = [self.vocabulary.get(t) for t in got] == [a, b]
        return known

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word (any text without a split inside)."""
        raw = word.encode("utf-8", "replace").decode("latin-1").translate(self.letter_of)
        text = raw[:-1] + self.last[raw[-1]]
        # the longest tokens one after another, which backtracking tries first anyway
        greedy = [token for _, token in self.automaton.iter_long(text)]
        pairs, before = self.pairs, None
        for i, token in enumerate(greedy):
            if before is not None:
                fits = pairs.get((before, token))
                if not (self.compatible(before, token) if fits is None else fits):
                    return self.backtracked(text, greedy[:i], token)
            before = token
        return greedy

    def longest(self, text: str) -> int | None:
        """The longest token that text starts with."""
        folded, n = self.folded, self.automaton.longest_prefix(text)
        while n and text[:n] not in folded:  # a branch of the automaton need not end in a token
            n -= 1
        return folded[text[:n]] if n else None

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of the given one."""
        if token not in self.next_shorter:
            text = self.text_of[token]
            self.next_shorter[token] = next((self.folded[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.folded), None)
        return self.next_shorter[token]

    def backtracked(self, text: str, taken: list[int], token: int | None) -> list[int]:
        """Token ids of a word whose last letter is folded, from tokens taken and one to try next."""
        sizes, pairs = self.sizes, self.pairs
        dead: set[int] = set()
        at, end = sum(sizes[t] for t in taken), len(text)
        while True:
            while token is not None:
                to = at + sizes[token]
                if to not in dead:
                    fits = not taken or pairs.get((taken[-1], token))
                    if self.compatible(taken[-1], token) if fits is None else fits:
                        break
                token = self.shorter(token)
            if token is None:
                if not taken:
                    raise ValueError("the vocabulary lacks a letter")
                dead.add(at)
                token = taken.pop()
                at -= sizes[token]
                token = self.shorter(token)
                continue
            taken.append(token)
            at = to
            if at == end:
                return taken
            token = self.longest(text[at : at + self.widest])

    def pieces(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens; white space only parts them."""
        if not UNLIKE.search(text):
            return PLAIN.findall((text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower())
        # each letter is lowered alone: no final form
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        new = {c for c in set(text) if unicodedata.category(c) == "Cn"}
        if not new:
            return PIECE.findall(text)
        # characters that this Unicode version lacks count as symbols
        seen = text.translate({ord(c): "\u2603" for c in new})
        return [text[m.start() : m.end()] for m in PIECE.finditer(seen)]

    def _chunk(self, chunk: str) -> bytes:
        """The ids, as 32-bit integers, of a stretch without white space."""
        found = b"".join([self.words.get(p) or self._word(p) for p in self.pieces(chunk)])
        if len(chunk) <= LONG:
            if len(self.chunks) >= CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def _word(self, word: str) -> bytes:
        found = array("i", self.encode_word(word)).tobytes()
        if len(word) <= LONG:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Token ids. White space parts words; where unlike characters are, stretches between it are looked up whole."""
        parts = [text]
        if self.splitter and any(s in text for s in self.special):
            parts = self.splitter.split(text)
        found: list[bytes] = []
        get, chunk, known, word = self.chunks.get, self._chunk, self.words.get, self._word
        for part in parts:
            if len(parts) > 1 and part in self.special:
                found.append(array("i", [self.special[part]]).tobytes())
                continue
            for span in spans(part):
                if not UNLIKE.search(span):
                    own = [known(p) or word(p) for p in self.pieces(span)]
                elif OTHER_SPACE.search(span):  # str.split() parts these too, the tokenizer doesn't
                    own = [chunk(span)]
                else:
                    own = [get(p) or chunk(p) for p in span.split()]
                found.append(b"".join(own))
        return np.frombuffer(b"".join(found), np.int32)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by spaces."""
        return b"".join(gathered(ids, self.digits, self.digit_offsets))

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts joined by spaces, special tokens too."""
        return b"".join(gathered(ids, self.blob, self.offsets))

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of decimal(ids) and of decode(ids), which are not held whole."""
        return digest(gathered(ids, self.digits, self.digit_offsets)), digest(gathered(ids, self.blob, self.offsets))


def _worker(sent, keep_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch, texts in text_slices(batches, "text"):
            sizes, digests, held = [], [], []
            for text in texts:
                ids = codec.encode(text or "")
                sizes.append(len(ids))
                digests.append(codec.digests(ids))
                if keep_ids:
                    held.append(ids)
            if keep_ids:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(held), pa.int32()))
            else:
                lists = pa.nulls(len(texts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64())]
                + [pa.array(c, pa.string()) for c in zip(*digests, strict=True)]
                + [lists],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return work


def encoded(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (with keep_ids).

    docs: doc_id, text; further columns are ignored. vocabulary: path of a tokenizer file on the
    driver. Null texts count as empty and have no tokens. Repeated rows give a row each; an empty
    table gives none.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), _worker(sent, keep_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
