"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and limits that results depend on.
INJECTIONS = [
    r"ignore\s+(?:all\s+|any\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+instructions",
    r"disregard\s+(?:all\s+|the\s+)?(?:previous|prior|above|system)\b",
    r"forget\s+(?:everything|all\s+(?:previous|prior)|your\s+instructions)",
    r"\b(?:reveal|show|print|repeat|expose|leak)\b.{0,30}\b(?:system\s+prompt|your\s+instructions|prompt)\b",
    r"\byou\s+are\s+now\b.{0,40}\b(?:DAN|developer\s+mode|unrestricted|jailbroken)\b",
    r"\bdeveloper\s+mode\b",
    r"\bpretend\s+(?:you\s+are|to\s+be)\b.{0,40}\b(?:no\s+restrictions|unfiltered|evil)\b",
    r"\bact\s+as\b.{0,30}\b(?:unfiltered|unrestricted|jailbroken|without\s+restrictions)\b",
    r"\boverride\b.{0,20}\b(?:safety|guardrails|restrictions|system)\b",
    r"\bnew\s+instructions?\s*:\s*",
    r"<\s*/?\s*(?:system|im_start|im_end)\s*>",
]
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LONG_NUMBER = r"(?<!\w)(?:\+?\d[\d\s().-]{6,}\d)(?!\w)"
EMAIL_MASK, NUMBER_MASK = "[redacted-email]", "[redacted-number]"
STOPWORDS = (
    "the a an of to in on for and or is are was were be been being it its this that these those "
    "you your we our they their i he she as at by with from will would can could may might do does "
    "did have has had not no yes but if then so than there here about into over under more most"
).split()
PORTUGUESE_LETTERS = "ãõáéíóúâêôàç"
# End of fixed values.

SUPPORT = 0.6
SUPPORTED_FILES = [".pdf", ".docx", ".html", ".htm", ".txt", ".md", ".markdown", ".text"]


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def clean_text(text: Column) -> Column:
    """Three or more newlines become two, runs of spaces one; outer white space goes."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " "))


def chunk_hash(text: Column) -> Column:
    return F.md5(clean_text(text))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def entry_id(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("synthesized:"), F.substring(F.sha2(F.concat(question, answer), 256), 1, 12))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for names that begin with their only dot."""
    base = F.element_at(F.split(F.split_part(F.split_part(name, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))


def supported(name: Column) -> Column:
    return extension(name).isin(SUPPORTED_FILES)


def slug(raw: Column) -> Column:
    base = F.element_at(F.split(raw, "/"), -1)
    kinds = "|".join(x[1:] for x in SUPPORTED_FILES)
    base = F.regexp_replace(base, rf"(?i)^(.+)\.(?:{kinds})$", "$1")
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, "^_+", ""), "_+$", "")
    cut = trimmed(F.substring(trimmed(F.regexp_replace(base, "[^A-Za-z0-9_-]+", "_")), 1, 128))
    return F.when(F.length(cut) == 0, F.lit("document")).otherwise(cut)


def shortened(text: Column, limit: int) -> Column:
    """Cut at limit, back to the last space, with an ellipsis; short texts stay."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", ""), r"\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def snippet(text: Column) -> Column:
    body = strip(text)
    rest = strip(F.regexp_replace(body, r"^#[^\n]*\n?", ""))
    body = F.when(body.startswith("#") & (F.length(rest) > 0), rest).otherwise(body)
    return shortened(body, 200)


def masked(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, EMAIL_MASK), LONG_NUMBER, NUMBER_MASK)


def injection(text: Column) -> Column:
    """The first pattern that occurs, or null."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(f"(?i){p}")), F.lit(p)) for p in INJECTIONS])


def language(text: Column, stopwords: list[str] | None = None) -> Column:
    """Label by script, letters and, for four words or more, the share of given stopwords; English else."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))
    share = F.size(F.filter(words, lambda w: w.isin(*stopwords))) / F.size(words) if stopwords else F.lit(0.0)
    return (
        F.when(F.rlike(text, F.lit("[؀-ۿ]")), "Arabic")
        .when(F.rlike(F.lower(text), F.lit(f"[{PORTUGUESE_LETTERS}]")), "European Portuguese")
        .when((F.size(words) >= 4) & (share > 0.5), "European Portuguese")
        .otherwise("English")
    )


def language_code(label: Column) -> Column:
    return F.when(label == "Arabic", "ar").when(label == "European Portuguese", "pt").otherwise("en")


def content_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))


def bm25_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def groundedness(answer: Column, known: Column) -> Column:
    """Share of the answer's sentences with SUPPORT of their content tokens in `known` (an array)."""
    sets = F.filter(F.transform(F.split(answer, r"[.!?\n]+"), content_tokens), lambda s: F.size(s) > 0)
    good = F.filter(sets, lambda s: F.size(F.array_intersect(s, known)) / F.size(s) >= SUPPORT)
    return F.when((F.size(known) == 0) | (F.size(sets) == 0), F.lit(0.0)).otherwise(F.size(good) / F.size(sets))


def bucket(score: Column, least: float) -> Column:
    return F.when(score >= least, "supported").when(score <= 0, "unsupported").otherwise("partial")


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def replacement_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.replace(text, F.lit("�")))) / n).otherwise(0.0)


def script_language(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"[\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")), "ko").otherwise("en")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def badge(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def version_major(text: Column) -> Column:
    """Major version: 1.8 counts as 8."""
    old = F.regexp_extract(text, r"^1\.(\d+)", 1)
    return F.when(old != "", old).otherwise(F.regexp_extract(text, r"^(\d+)", 1)).try_cast("int")
