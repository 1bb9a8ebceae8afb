"""Validation, address and parsing functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from docuflux.functions.text import clean_text, strip

# Limits, patterns, host names and statuses that results depend on.
NAME_LIMIT, QUESTION_LIMIT, DOWNLOAD_LIMIT = 128, 2000, 50 * 1024 * 1024
PAGES = r"^\d+(-\d+)?(,\d+(-\d+)?)*$"
USER_ID = r"^[A-Za-z0-9_.@-]{1,128}$"
METADATA_HOSTS = ["metadata.google.internal", "metadata", "localhost"]
TRANSIENT_STATUSES = [429, 500, 502, 503, 504]
TRANSIENT_HINTS = ["timeout", "connection", "ratelimit", "serviceunavailable", "internalservererror", "apiconnection", "apitimeout"]
BLOCKED_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
BLOCKED_V6 = r"^(?:::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*)$"
# End of fixed values.

V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def name_error(raw: Column) -> Column:
    """Why a document name is refused: empty, separator or long; null when it is good."""
    name = strip(raw)
    return F.when(F.length(name) == 0, "empty").when(F.rlike(name, F.lit(r"[/\\.]")), "separator").when(F.length(name) > NAME_LIMIT, "long")


def pages_valid(spec: Column) -> Column:
    """Whether a page list is well formed; none is."""
    return spec.isNull() | F.rlike(spec, F.lit(PAGES))


def v4_number(address: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = lambda i: F.split_part(address, F.lit("."), F.lit(i)).cast("long")
    return F.when(F.rlike(address, F.lit(V4)), part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * 256 + part(4))


def in_networks(address: Column, networks: list[str]) -> Column:
    """Whether an IPv4 address lies in one of the networks (CIDR) or any text equals one; networks
    of other kinds, and malformed ones, match nothing."""
    plain, bounds = [n for n in networks if "/" not in n], []
    for n in networks:
        try:
            net = ipaddress.ip_network(n, strict=False) if "/" in n else None
        except ValueError:
            continue
        if net is not None and net.version == 4:
            bounds.append(F.struct(F.lit(int(net.network_address)).cast("long").alias("lo"), F.lit(int(net.broadcast_address)).cast("long").alias("hi")))
    named = address.isin(plain) if plain else F.lit(False)
    # the number is made once and bound
    inside = F.exists(F.array(v4_number(address)), lambda x: F.exists(F.array(*bounds), lambda n: x.between(n["lo"], n["hi"]))) if bounds else F.lit(False)
    return named | F.coalesce(inside, F.lit(False))


def internal_host(host: Column) -> Column:
    """Whether a host is an internal address or a metadata name; names are not resolved."""
    name = F.lower(host)
    return in_networks(name, BLOCKED_V4) | F.rlike(name, F.lit(BLOCKED_V6)) | name.isin(METADATA_HOSTS)


def host_of(url: Column) -> Column:
    """The host of a url without user, port and brackets; null without one."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"[\[\]]", "")), F.lit(""))


def url_error(url: Column, allowed: list[str]) -> Column:
    """Why a download is refused: host, internal or unlisted; null when it may go ahead. With "*"
    any host that is not internal may; a listed host may whatever it is."""
    host = host_of(url)
    listed = host.isin(allowed) if allowed else F.lit(False)
    if "*" in allowed:
        return F.when(host.isNull(), "host").when(internal_host(host), "internal")
    return F.when(host.isNull(), "host").when(listed, None).when(internal_host(host), "internal").otherwise("unlisted")


def path_allowed(path: Column, roots: list[str]) -> Column:
    """Whether an absolute path without . and .. parts lies in one of the folders."""
    plain = path.startswith("/") & ~F.rlike(path, F.lit(r"(?:^|/)\.{1,2}(?:/|$)"))
    inside = F.lit(False)
    for root in roots:
        base = root.rstrip("/")
        inside = inside | (path == base) | path.startswith(base + "/")
    return plain & inside


def client_address(direct: Column, forwarded: Column, real: Column, trusted: list[str]) -> Column:
    """The caller's address: of trusted proxies the last forwarded hop, else the named one."""
    peer = F.coalesce(direct, F.lit("unknown"))
    hop = strip(F.element_at(F.split(forwarded, ","), -1))
    passed = F.when(F.length(forwarded) > 0, hop).when(F.length(real) > 0, real).otherwise(peer)
    return F.when(in_networks(peer, trusted), passed).otherwise(peer)


def box(values: Column) -> Column:
    """Four finite numbers, or null."""
    good = (F.size(values) == 4) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, values)


def replaced_unknown(text: Column, stand_in: str) -> Column:
    """U+FFFD by a stand-in of one's own."""
    return text if stand_in == "�" else F.replace(text, F.lit("�"), F.lit(stand_in))


def without_private_use(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]", "")


def without_nulls(text: Column) -> Column:
    """Null characters by U+FFFD; a Spark string holds no lone surrogates."""
    return F.regexp_replace(text, r"\x00", "�")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def grounded(raw: Column) -> Column:
    """A judge's verdict: the truth of "grounded" in the first to last brace; unreadable is grounded."""
    text = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    said = F.get_json_object(text, "$.grounded")
    truth = said.isNotNull() & ~said.isin("false", "0", "0.0", "", "[]", "{}")
    return F.when(F.try_parse_json(F.when(text != "", text)).isNull(), F.lit(True)).otherwise(truth)


def citation(source: Column, page: Column, bbox: Column) -> Column:
    """Source, page and position as far as they are known."""
    at = F.concat(F.lit("Position ("), F.format_string("%.0f", F.get(bbox, F.lit(0))), F.lit(", "), F.format_string("%.0f", F.get(bbox, F.lit(1))), F.lit(")"))
    return F.concat_ws(", ", F.concat(F.lit("Source: "), F.coalesce(source, F.lit("unknown"))), F.when(page > 0, F.concat(F.lit("Page "), page.cast("string"))), F.when(F.size(bbox) >= 2, at))


def failed_pages(errors: Column) -> Column:
    """Page numbers that error messages start with, sorted and distinct."""
    numbers = F.transform(errors, lambda e: F.regexp_extract(e, r"^Page\s+(\d+)(?::|$)", 1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: n.cast("int"))))


def contexts(text: Column) -> Column:
    """Paragraphs that are not blank; one empty one if there is none."""
    parts = F.filter(F.split(text, "\n\n"), lambda p: F.length(strip(p)) > 0)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))


def transient(kind: Column, status: Column) -> Column:
    """Whether a failure is worth another try, by its status or the name of its kind."""
    name = F.lower(kind)
    hint = F.lit(False)
    for h in TRANSIENT_HINTS:
        hint = hint | F.contains(name, F.lit(h))
    return F.coalesce(status.isin(TRANSIENT_STATUSES), F.lit(False)) | F.coalesce(hint, F.lit(False))


def backoff(attempt: Column, base: float, most: float) -> Column:
    """Seconds to wait after an attempt counted from 1: doubled each time, bounded."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def bullet_length(text: Column) -> Column:
    """Length of a leading bullet or number with the space after it."""
    return F.length(F.regexp_extract(text, r"^\s*(?:[•◦▪‣·*+-]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+", 0))


#: Parts of prompts by mode: what the assistant may use, and what to do without it.
MODES = {
    "strict": "Answer only from the context below. If it does not hold the answer, say that you do not know.",
    "open": "Prefer the context below; where it is silent you may use general knowledge and must say so.",
    "learning": "Use the context below and general knowledge; the answer may be kept for later questions.",
    "learning_review": "Use the context below and general knowledge; a person reviews the answer before it is kept.",
}


def prompt(mode: Column, language: Column, summary: Column, history: Column, context: Column, question: Column) -> Column:
    """A question's prompt: the mode's rule, the language, and what parts there are. Unknown modes are strict."""
    rule = F.lit(MODES["strict"])
    for name, text in MODES.items():
        rule = F.when(mode == name, F.lit(text)).otherwise(rule)
    part = lambda head, c: F.when(F.length(strip(c)) > 0, F.concat(F.lit(f"{head}:\n"), c))
    return F.concat_ws("\n\n", rule, F.concat(F.lit("Answer in "), language, F.lit(".")), part("Summary", summary), part("History", history), part("Context", context), F.concat(F.lit("Question: "), question))


def kept_answer(mode: Column, best_score: Column, answer: Column, threshold: float, least: int) -> Column:
    """Whether a learning answer fills a gap and is long enough to keep."""
    return mode.isin("learning", "learning_review") & (best_score < threshold) & (F.length(strip(answer)) >= least)


def chunk_key(text: Column) -> Column:
    return F.md5(clean_text(text))
