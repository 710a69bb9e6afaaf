"""Column functions on text: whitespace, keys, sentence and style tests, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of targets that carry pipeline telemetry.
TELEMETRY = (r"\bquality_flags\b", r"\breason_codes\b", r"\brejected_candidates\b", r"\brejected_candidate_stats\b", r"\brejected_[a-z_]+\b")
#: Patterns of low-quality notes.
LOW_QUALITY = (
    r"^\s*node content\.?\s*(part of speech)?\.?\s*$",
    r"\bpart of speech\b",
    r"\bverb-?centred phrase expressing what happens to or about the subject\b",
    r"\bsubordinate clause of concession\b",
    r"\bsubordinate clause of reason\b",
    r"\bsubordinate clause of reference\b",
    r"^\s*sentence:\s*",
)
#: Prefixes and substrings that hard rules ban.
BANNED_PREFIXES = ("sentence:", "phrase:", "word:", "node content", "part of speech", "node type")
BANNED_SUBSTRINGS = ("sensibilisation", "sensence", "nod to", "node content", "none. node content", "sensual", "sensational")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: str | Column) -> Column:
    """White space runs become one space; none at either end.  Unicode white space, as Java needs (?U) for."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def norm_key(c: str | Column) -> Column:
    return F.lower(squeeze(c))


def sentence_parts(c: str | Column) -> Column:
    """Parts after sentence ends, by a marker instead of a look-behind."""
    return F.split(F.regexp_replace(col(c), r"([.!?]) ", "$1\u0001"), "\u0001")


def looks_like_sentence(c: str | Column) -> Column:
    n = F.length(col(c))
    return n.between(8, 260) & (F.length(F.regexp_replace(col(c), r"[^\p{L}]", "")) >= 4)


def strip_html(c: str | Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(col(c), r"<[^>]+>", " "), r"&[a-z]+;", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def any_match(c: str | Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    """Whether one of the patterns is found: one alternation, so the text is walked once; patterns that begin at the text's start or at a word's edge are tried only there."""
    begun = lambda mark: [f"(?:{p})" for p in patterns if p.startswith(mark)]
    tried = [f"(?:{p})" for p in patterns if not p.startswith(("^", r"\b"))] + [f"{mark}(?:{'|'.join(begun(mark))})" for mark in ("^", r"\b") if begun(mark)]
    return col(c).rlike(flags + "(?:" + "|".join(tried) + ")")


def sentence_count(c: str | Column) -> Column:
    return F.size(F.filter(F.split(col(c), "[.!?]+"), lambda s: F.trim(s) != ""))


def target_reason(c: str | Column) -> Column:
    """Why a training target is refused; null if it is kept."""
    clean = F.trim(col(c))
    styled = ~any_match(clean, LOW_QUALITY) & sentence_count(clean).between(1, 2)
    return F.when(clean == "", "EMPTY").when(any_match(clean, TELEMETRY), "TELEMETRY").when(~styled, "LOW_QUALITY_STYLE")


def hard_rule_ok(c: str | Column) -> Column:
    s = squeeze(c)
    low = F.lower(s)
    banned = F.lit(False)
    for p in BANNED_PREFIXES:
        banned = banned | F.startswith(low, F.lit(p))
    for p in BANNED_SUBSTRINGS:
        banned = banned | F.contains(low, F.lit(p))
    return (
        (s != "") & (F.size(F.split(s, " ")) <= 30) & sentence_count(s).between(1, 2) & ~banned
        & ~s.rlike(r"[<{].*[>}]") & ~low.rlike(r"\b(i|you|we|llm|chatgpt|model)\b")
    )


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z']+"), 0)


def variant_index(parts: list[Column], modulus: int) -> Column:
    """A stable choice among `modulus` variants: the first 32 bits of a SHA-256."""
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit("|"), p) if i else (p,))])
    return (F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long") % modulus).cast("int")


def sentence_hash(text: str | Column, index: str | Column) -> Column:
    return F.sha2(F.concat(norm_key(text), F.lit("|"), col(index).cast("string")), 256)


def sentence_key(text: Column, source: Column, target: Column, context: Column) -> Column:
    """context: canonical JSON.  ASCII text needs no NFC step; see providers for others."""
    return F.sha2(F.concat(F.lit("v1|"), squeeze(text), F.lit("|"), F.lower(source), F.lit("|"), F.lower(target), F.lit("|"), context), 256)
