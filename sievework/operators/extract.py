"""Raw pages to text: HTML, MIME archives, calendar XML."""

from __future__ import annotations

import email
import email.policy
import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.durable import ship
from sievework.functions.numbers import day8

# Parts of a page that are no text, and the containers of the main text.
DROPPED = {"script", "style", "noscript", "svg", "template"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = (("id", "divSecondPageColumns"), ("class", "page-content__center"))
POPUP = re.compile(r"popup|modal|cookie", re.I)
# Month names of the calendar.
MONTHS = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")


class _Reader(HTMLParser):
    """Collects text, the main container's text, title, heading and links in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.hidden = 0
        self.inside = [0] * len(CONTAINERS)
        self.text: list[str] = []
        self.main: list[list[str]] = [[] for _ in CONTAINERS]
        self.heading: list[str] = []
        self.title: list[str] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        have = {k: v or "" for k, v in attrs}
        if tag == "a" and have.get("href"):
            self.links.append(have["href"])
        if tag in BLOCKS:
            self._add("\n")
        if tag in VOID:
            return
        hide = tag in DROPPED or bool(POPUP.search(have.get("class", "") + " " + have.get("id", "")))
        kept = -1
        for i, (key, value) in enumerate(CONTAINERS):
            if value in have.get(key, "").split():
                kept = i
                self.inside[i] += 1
        self.hidden += hide
        self.stack.append((tag, hide, kept))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._add("\n")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for _, hide, kept in self.stack[i:]:
                    self.hidden -= hide
                    if kept >= 0:
                        self.inside[kept] -= 1
                del self.stack[i:]
                return

    def handle_data(self, data):
        if any(t == "title" for t, _, _ in self.stack):
            self.title.append(data)
            return
        if any(t == "h1" for t, _, _ in self.stack) and not self.hidden:
            self.heading.append(data)
        self._add(data)

    def _add(self, data):
        if self.hidden:
            return
        self.text.append(data)
        for i, depth in enumerate(self.inside):
            if depth:
                self.main[i].append(data)


def _tidy(parts: list[str]) -> str:
    text = re.sub(r"[ \t\xa0]+", " ", "".join(parts))
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def read_html(page: str) -> dict:
    """main text, whole text, title (first heading, else title; 800 characters), links."""
    r = _Reader()
    r.feed(page)
    r.close()
    main = next((t for p in r.main if (t := _tidy(p))), None)
    title = " ".join("".join(r.heading or r.title).split())[:800] or None
    return {"main": main or _tidy(r.text), "text": _tidy(r.text), "title": title, "links": list(dict.fromkeys(r.links))}


def html_of_mime(blob: bytes) -> str:
    """The first HTML part of a MIME archive, decoded with its own charset."""
    message = email.message_from_bytes(blob, policy=email.policy.default)
    for part in message.walk():
        if part.get_content_type() == "text/html":
            raw = part.get_payload(decode=True) or b""
            try:
                return raw.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                return raw.decode("utf-8", "replace")
    return ""


def sniff(url: str | None, blob: bytes) -> str:
    """xml by its address, mhtml by a MIME header near the start, else html."""
    if (url or "").lower().split("?")[0].endswith(".xml"):
        return "xml"
    head = blob[:2048].lower()
    return "mhtml" if b"mime-version:" in head or b"content-type: multipart/related" in head else "html"


_PAGE = "kind string, main string, text string, title string, links array<string>"


def extracted(pages: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """Adds ``page``: struct of kind, main text, text, title and distinct links in order.

    ``content`` is binary; a null one gives a null struct.
    """
    ship(pages.sparkSession)

    @F.pandas_udf(_PAGE)
    def page(urls: pd.Series, blobs: pd.Series) -> pd.DataFrame:
        out = []
        for u, b in zip(urls, blobs):
            if b is None:
                out.append((None,) * 5)
                continue
            kind = sniff(u, b)
            if kind == "xml":
                out.append((kind, None, b.decode("utf-8", "replace"), None, []))
                continue
            r = read_html(html_of_mime(b) if kind == "mhtml" else b.decode("utf-8", "replace"))
            out.append((kind, r["main"], r["text"], r["title"], r["links"]))
        return pd.DataFrame(out, columns=["kind", "main", "text", "title", "links"])

    return pages.withColumn("page", page(F.col(url), F.col(content)))


_CALENDAR = "title string, year array<struct<_index int, month array<struct<_name string, day array<struct<_num int, _type string, _VALUE string>>>>>>"


def calendar_days(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(title, day, kind, text) of every day with a known month, number and type, in order."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    c = xml.select(F.from_xml(F.col(column), _CALENDAR).alias("c")).select("c.title", F.explode("c.year").alias("y"))
    m = c.select("title", F.col("y._index").alias("year"), F.explode("y.month").alias("m"))
    d = m.select("title", "year", F.element_at(months, F.lower(F.trim("m._name"))).alias("month"), F.explode("m.day").alias("d"))
    rows = d.filter("month is not null and d._num is not null and coalesce(d._type, '') <> ''")
    return rows.select("title", F.make_date("year", "month", "d._num").alias("day"), F.col("d._type").alias("kind"), F.trim(F.coalesce("d._VALUE", F.lit(""))).alias("text"))


def calendar_text(days: DataFrame) -> DataFrame:
    """(title, text): a line for each day with text, in order of days."""
    line = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" ["), F.col("kind"), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("day", line.alias("line")))))
    return days.groupBy("title").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def latest_dataset(links: DataFrame, url: str = "url") -> DataFrame:
    """The address with the latest ``data-YYYYMMDD-structure`` date."""
    date = day8(F.regexp_extract(url, r"data-(\d{8})-structure-[^/]*\.xml", 1))
    return links.withColumn("_d", date).filter("_d is not null").agg(F.max_by(url, F.struct("_d", F.col(url))).alias("url"))


def unescaped(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else html.unescape(t)), "string")(text)
