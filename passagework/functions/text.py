"""Text functions as Catalyst expressions; a null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a word with the white space before it, so joined tokens are the text again.
TOKEN = r"[ \t\n\f\r]*[^ \t\n\f\r]+"
#: White space of any kind.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINKS = "|".join((r"\bavailable free of charge\b", "@", "https?://", r"doi\.org"))
BOILERPLATE = "|".join(("list of (?:tables|figures)", "table of contents", "keywords$", "abstract$", "acknowledgement", r"doi\.org", r"nist\.sp\.", "this publication is available"))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is in a text; stops at the first other character."""
    return ~text.rlike(f"[^{SPACES}]")


def clean(text: Column) -> Column:
    """No-break spaces to spaces, runs of spaces and tabs to one, ends stripped."""
    return strip(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), "[ \t]{2,}|\t", " "))


def tokens(text: Column) -> Column:
    """Word tokens."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    """Word tokens of a text; of null 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def normalise(text: Column) -> Column:
    """What of a text counts in comparisons: words in lower case, one space between."""
    joined = F.lower(F.regexp_replace(text, f"[-\u2013\u2014][{SPACES}]*\n[{SPACES}]*", ""))
    return F.btrim(F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))


def words(text: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.filter(F.split(normalise(text), " "), lambda w: w != "")


def bag_overlap(candidate: Column, gold: Column) -> Column:
    """Share of gold's words, with multiplicity, that candidate has too."""
    hits = F.aggregate(
        F.array_distinct(gold),
        F.lit(0),
        lambda acc, w: acc + F.least(F.size(F.filter(gold, lambda x: x == w)), F.size(F.filter(candidate, lambda x: x == w))),
    )
    return F.when(F.size(gold) == 0, 0.0).otherwise(hits / F.size(gold))


def coverage(candidate: Column, gold: Column) -> Column:
    """Best bag overlap of gold with a window of its size, at a quarter's steps (M03). Both are arrays of words."""
    n, w = F.size(candidate), F.size(gold)
    step = F.greatest(F.lit(1), F.floor(w / 4).cast("int"))
    slid = F.array_max(F.transform(F.sequence(F.lit(0), n - w, step), lambda s: bag_overlap(F.slice(candidate, s + 1, w), gold)))
    return F.when((n == 0) | (w == 0), 0.0).when(n <= w, bag_overlap(candidate, gold)).otherwise(slid)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def looks_like_heading(text: Column, most: int = 120) -> Column:
    """Short, mostly letters, and neither a link nor an address."""
    size, alnum = F.length(text), F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    banned = F.lower(text).rlike(LINKS)
    return (size <= most) & ~banned & (alnum >= 2) & (letters(text) >= 3) & (letters(text) / size >= 0.4) & (alnum / size >= 0.5)


def is_prose(text: Column) -> Column:
    """Neither boilerplate nor dot leaders, formulas or numbers, and at least 60 words."""
    ws = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")
    odd = F.size(F.filter(ws, lambda w: (F.length(w) > 18) | (w.rlike("[0-9]") & (F.length(w) > 8))))
    banned = F.lower(text).rlike(BOILERPLATE)
    size = F.greatest(F.length(text), F.lit(1))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return ~banned & (dots / size <= 0.08) & (letters(text) / size >= 0.65) & (F.size(ws) >= 60) & (odd / F.greatest(F.size(ws), F.lit(1)) <= 0.06)


def furniture_key(text: Column) -> Column:
    """A text without digits, in lower case, stripped: equal on pages that differ in their number."""
    return strip(F.lower(F.regexp_replace(text, r"(?U)\d+", "")))


def content_hash(data: Column) -> Column:
    """The first 32 digits of SHA-256."""
    return F.substring(F.sha2(data.cast("binary"), 256), 1, 32)
