"""Text functions as Column expressions: terms, identifiers, similarity, estimates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_BREAK = r"[^\p{L}\p{N}_$#.]+"
TOKEN = r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"
# Where identifiers are taken apart.
BREAK_LOWER_UPPER = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})"
BREAK_ACRONYM = r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def terms(text: Column, least: int = 1) -> Column:
    """Distinct lower-cased query terms in order, of at least ``least`` characters."""
    parts = F.split(F.lower(text), TERM_BREAK)
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= least))


def all_terms(text: Column) -> Column:
    """Lower-cased query terms in order, with repeats: what a file's path is scored by."""
    return F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Lower-cased words as an analyser sees them, in order and with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def split_identifiers(text: Column) -> Column:
    """Camel case and acronyms taken apart, everything but letters and digits a space."""
    parted = F.regexp_replace(F.regexp_replace(text, BREAK_ACRONYM, " "), BREAK_LOWER_UPPER, " ")
    return F.trim(F.regexp_replace(parted, r"[^\p{L}\p{N}]+", " "))


def identifier_tokens(text: Column) -> Column:
    """The lower-cased words of split_identifiers(), without making its text. Texts without camel case are only looked at."""
    parted = F.regexp_replace(F.regexp_replace(text, BREAK_ACRONYM, " "), BREAK_LOWER_UPPER, " ")
    whole = F.when(text.rlike(r"[\p{Ll}\p{Nd}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"), parted).otherwise(text)
    return F.regexp_extract_all(F.lower(whole), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, ignoring case; 0 if either is empty."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(x), F.length(y))
    near = 1 - F.levenshtein(x, y) / F.greatest(longer, F.lit(1))
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(near)


def path_score(path: Column, words: Column) -> Column:
    """The share of ``words`` that the lower-cased path contains; 0 without words."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    hits = F.size(F.filter(words, lambda t: low.contains(t)))
    return F.when(F.size(words) == 0, 0.0).otherwise(hits / F.greatest(F.size(words), F.lit(1)))


def exact_symbol(name: Column, qualified: Column, query: Column, words: Column) -> Column:
    """1 if the name or qualified name is the query or a term, or the qualified name ends in one; else 0."""
    n, q = F.lower(name), F.lower(qualified)
    hit = (n == query) | (q == query) | F.exists(words, lambda t: (n == t) | (q == t) | q.endswith(F.concat(F.lit("."), t)))
    return F.when(hit, 1.0).otherwise(0.0)


def fuzzy_symbol(name: Column, qualified: Column, words: Column) -> Column:
    """Over terms, the most of 0.9 if contained in a name and the similarity to the name."""
    n, q = F.lower(name), F.lower(qualified)
    each = F.transform(words, lambda t: F.greatest(F.when(n.contains(t) | q.contains(t), 0.9).otherwise(0.0), similarity(n, t)))
    return clamp01(F.coalesce(F.array_max(each), F.lit(0.0)))


def token_estimate(text: Column) -> Column:
    """Tokens of a context item: code points / 3.5, rounded up, at least 1 unless empty."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(3.5)).cast("int"))).cast("int")


def scan_estimate(size: Column) -> Column:
    """Tokens of a scanned file of ``size`` bytes."""
    return F.greatest(F.lit(1), F.floor((size + 3) / 4)).cast("int")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, path: Column, length: int = 320) -> Column:
    flat = F.substring(squeezed(text), 1, length)
    return F.when(F.length(flat) == 0, path).otherwise(flat)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with one kind of line end and no white space around it."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.sha2(F.regexp_replace(lines, r"^[ \t\n]+|[ \t\n]+$", ""), 256)


def _accents() -> tuple[str, str]:
    """(letters, what they are without marks): every letter below U+2000 whose decomposition is one plain letter and marks."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            pairs.append((c, plain))
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _accents()


def folded(text: Column) -> Column:
    """Lower case without accents, squeezed: letters of their own and those followed by marks."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return squeezed(F.regexp_replace(plain, r"\p{Mn}+", ""))


def stem(token: Column) -> Column:
    """A light stem; the first ending that fits goes."""
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    ends = lambda s, least: token.endswith(s) & (F.length(token) > least)
    return F.when(ends("ing", 5), cut(3)).when(ends("ed", 4), cut(2)).when(ends("es", 4), cut(2)).when(ends("s", 3), cut(1)).otherwise(token)
