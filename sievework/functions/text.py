"""Text expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words of three or more letters or digits count as search terms.
TERM = "[0-9A-Za-zА-Яа-яЁё]{3,}"
FOLDED_TERM = "[0-9a-zа-я]{3,}"
# Fixed value: the white space that Python's strip() removes.
STRIP = r"[\s\x0b\x1c-\x1f\x85   -     　]"


def fold(text: Column) -> Column:
    """Lower case, io written as ie."""
    # ``replace`` searches bytes; ``translate`` would look every character up.
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def terms(text: Column) -> Column:
    """array<string> of folded search terms in order; an empty array for null."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(FOLDED_TERM), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{STRIP}+|{STRIP}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{STRIP}+$", "")


def present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set of terms; 0 if either has none. Arrays of terms."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def shortened(text: Column, limit: int, mark: str = "…") -> Column:
    """At most ``limit`` characters, then the mark."""
    return F.when(F.length(text) > limit, F.concat(rstrip(F.left(text, F.lit(limit))), F.lit(mark))).otherwise(text)


def first_line(text: Column, limit: int = 500) -> Column:
    """The first line that is not blank, stripped; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")
    return F.left(F.get(lines, F.lit(0)), F.lit(limit))


def slug(text: Column) -> Column:
    """Safe for file names: other characters become one underscore."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def plain_query(text: Column) -> Column:
    """Folded, everything but letters and digits a space, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]", " "), " +", " "))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The stable UUID of a name (version 5)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring("89ab", 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab89ab89ab89ab"), nibble % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def url_parameter(url: Column, name: str) -> Column:
    """The value of a query parameter, null without it."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
