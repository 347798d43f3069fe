"""Lines of texts: what they are, which repeat, and texts without some of them.

The patterns use only what Java's and RE2's regular expressions share, so the same string
serves a plan and its SQL; they are applied to folded lines (lower case, io as ie).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import fold

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{2028}\\x{2029}]"
CONTROL = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\x{ad}\\x{600}-\\x{605}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{feff}]"
SOMETHING = CONTROL.replace("[", "[^\\s\\x{a0}", 1)
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"

# Words and patterns of lines with legal content.
LEGAL_WORDS = (
    "нк рф", "налоговый кодекс", "федеральный закон", "фз", "письмо", "приказ", "постановление", "определение",
    "решение", "статья", "пункт", "подпункт", "раздел", "глава", "приложение",
    "ндфл", "ндс", "усн", "нпд", "псн", "енвд", "налоговый агент", "налогоплательщик", "декларация", "уведомление",
    "вычет", "штраф", "пени", "срок", "доход", "расход",
)
LEGAL_PATTERNS = "|".join((
    _B + r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}" + _E,
    _B + r"[0-9]{1,2}\s+(?:январ[ья]|феврал[ья]|марта?|апрел[ья]|ма[йя]|июн[ья]|июл[ья]|август[ае]?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья])\s+[0-9]{4}" + _E,
    r"№\s*[\p{L}\p{N}_/.\-]",
    _B + r"n(?:\s+[\p{L}\p{N}_/.\-]|[/.\-])",
    _B + r"(?:статья|ст\.)\s*[0-9]",
    _B + r"(?:пункт|п\.|подпункт|подп\.)\s*[а-яa-z0-9.)(]",
    r"^\s*(?:[0-9]+\.\s+|[а-яa-z]\)\s+)",
    _B + r"[0-9][0-9\s]*(?:[.,][0-9]+)?\s*(?:руб" + _E + r"|руб\.[\p{L}\p{N}_]|₽[\p{L}\p{N}_])",
))
LEGAL = "|".join((*LEGAL_WORDS, LEGAL_PATTERNS))
# Lines that navigate a site.
NAVIGATION = "|".join((
    r"^.{1,160}[>›»]\s*[^>›»]{1,80}(?:[>›»]+\s*[^>›»]{1,80})*[>›»]*\s*$",
    _B + r"(?:версия\s+для\s+печати|поделиться|наверх|главная|поиск|личный\s+кабинет|подписаться|официальный\s+сайт|cookie)" + _E,
))
ALNUM, SIGN = "[0-9A-Za-zА-Яа-яЁё]", r"[^\p{L}\p{N}_\s]"
#: A line in more than this share of the documents is boilerplate; longer lines never are.
SHARE, LONGEST = 0.05, 120


def split_lines(text: Column) -> Column:
    """Lines as Python's splitlines() gives them: no empty one after a final break."""
    lines = F.split(text, LINE_BREAK, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def normal_line(line: Column) -> Column:
    spaced = F.regexp_replace(F.replace(line, F.lit(" "), F.lit(" ")), CONTROL, "")
    return F.regexp_replace(F.regexp_replace(spaced, "[ \\t]{2,}", " "), "^\\s+|\\s+$", "")


def normal_text(text: Column) -> Column:
    """White space put in order (composition of accents apart, which needs no plan of its own
    where the text is composed already)."""
    t = F.regexp_replace(F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("﻿"), F.lit("")), "\\r\\n|\\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, CONTROL, ""), "[ \\t]{2,}", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]+(\\n|$)", "$1"), "\\n{3,}", "\n\n")
    return F.regexp_replace(t, "^\\s+|\\s+$", "")


def is_legal(line: Column) -> Column:
    return legal_folded(fold(line))


def legal_folded(folded: Column) -> Column:
    """Words are looked for one by one, which is much faster than as one pattern; the patterns
    are tried where no word stands."""
    found = folded.contains(LEGAL_WORDS[0])
    for word in LEGAL_WORDS[1:]:
        found = found | folded.contains(word)
    return found | folded.rlike(LEGAL_PATTERNS)


def is_navigation(line: Column) -> Column:
    return fold(line).rlike(NAVIGATION)


def is_noise(line: Column) -> Column:
    """Tiny, or mostly signs."""
    known, signs, n = F.regexp_count(line, F.lit(ALNUM)), F.regexp_count(line, F.lit(SIGN)), F.length(line)
    return ((n <= 3) & (known <= 2)) | ((signs >= 4) & (signs > known)) | ((n <= 24) & (known <= 4))


def normal_lines(text: Column) -> Column:
    """The lines of a text, each normal: every pattern passes once over the text, not over each
    line."""
    text = F.coalesce(text, F.lit(""))
    t = F.replace(F.regexp_replace(text, LINE_BREAK, "\n"), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, CONTROL, ""), "[ \\t]{2,}", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t]?\\n[ \\t]?", "\n"), "^[ \\t]+|[ \\t]+$", "")
    lines = F.split(t, "\n", -1)
    # No empty line after a final break, and none of an empty text.
    ends = F.substring(text, -1, 1).rlike(LINE_BREAK) | (text == "")
    return F.when(ends, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def folded_lines(text: Column) -> Column:
    """array<struct<line, folded>>: each line is folded once, however often it is looked at."""
    return F.transform(normal_lines(text), lambda x: F.struct(x.alias("line"), fold(x).alias("folded")))


def kept(text: Column, keep) -> Column:
    """The text of the lines for which ``keep(line struct)`` holds."""
    return joined(F.transform(F.filter(folded_lines(text), keep), lambda x: x["line"]))


def joined(lines: Column) -> Column:
    return normal_text(F.array_join(lines, "\n"))


def boilerplate_lines(corpus: DataFrame, text: str = "text", share: float = SHARE, longest: int = LONGEST) -> DataFrame:
    """(line_key, docs): lines without legal content in more than ``share`` of the documents.

    ``corpus``: one row per document.  Lines are made distinct within their row, so the counts
    are summed map-side and only keys are shuffled; legal content is looked for in the few
    lines above the share.
    """
    filled = corpus.select(F.col(text).alias("text")).filter(F.col("text").rlike(SOMETHING))
    short = F.filter(normal_lines(F.col("text")), lambda x: (x != "") & (F.length(x) <= longest))
    keys = filled.select(F.explode(F.array_distinct(F.transform(short, fold))).alias("line_key"))
    counts = keys.groupBy("line_key").agg(F.count("*").alias("docs"))
    total = filled.agg(F.count("*").alias("total"))
    often = counts.crossJoin(F.broadcast(total)).filter(F.col("docs") > F.col("total") * share)
    return often.filter(~legal_folded(F.col("line_key"))).select("line_key", "docs")


#: Boilerplate lines that are sent along as one array; more are an error of their threshold.
MOST_LINES = 100_000


def gone_lines(boilerplate: DataFrame) -> DataFrame:
    """One row with the array of boilerplate lines, for a broadcast.

    A line of boilerplate stands in over a twentieth of the documents, so there are at most
    twenty times the lines of one text of it; with a threshold near 0 there may be more than
    can be sent, which is checked.
    """
    few = F.when(F.count("*") <= MOST_LINES, F.collect_set("line_key")).otherwise(F.raise_error(F.lit("too many boilerplate lines: raise the share")).cast("array<string>"))
    return boilerplate.limit(MOST_LINES + 1).agg(few.alias("gone"))


def without_boilerplate(corpus: DataFrame, boilerplate: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) without boilerplate lines; lines of legal content stay."""
    rest = kept(F.col(text), lambda x: ~F.array_contains(F.col("gone"), x["folded"]) | legal_folded(x["folded"]))
    return corpus.select(key, text).crossJoin(F.broadcast(gone_lines(boilerplate))).select(key, rest.alias("text"))


# The cheap conditions stand first: legal content is looked for only in lines that would go.
def without_navigation(text: Column) -> Column:
    return kept(text, lambda x: (x["line"] == "") | ~x["folded"].rlike(NAVIGATION) | legal_folded(x["folded"]))


def without_noise(text: Column) -> Column:
    return kept(text, lambda x: (x["line"] == "") | ~(is_noise(x["line"]) | x["folded"].rlike(NAVIGATION)) | legal_folded(x["folded"]))


def without_repeats(text: Column) -> Column:
    """The first of equal lines stays; lines of legal content all stay."""
    rows = folded_lines(text)
    keys = F.transform(rows, lambda x: x["folded"])
    fine = F.filter(rows, lambda x, i: (x["line"] == "") | (F.array_position(keys, x["folded"]) == i + 1) | legal_folded(x["folded"]))
    return joined(F.transform(fine, lambda x: x["line"]))
