"""Finding documents of sources and fetching them, with a client that is given.

There is no network here: ``get(url) -> str`` and ``client(...)`` come from outside, so the
rules can run over a crawler, an archive or a table of pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import ship
from sievework.operators.extract import read_html

_NUMBER = re.compile(r"\b(\d+)\b")
# Where a page says which of a listing's pages it is.
ACTIVE_TAGS, PAGER_CLASSES = ("li", "a", "span"), ("pagination", "pager")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Discovered(NamedTuple):
    """A document that a source names."""

    source_code: str
    external_id: str | None
    canonical_url: str
    kind: str | None = None
    title: str | None = None


class _Pager(HTMLParser):
    """Texts of the first active element and of the first pager."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.found: dict[str, list[str]] = {}
        self.closed: set[str] = set()

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        role = "active" if tag in ACTIVE_TAGS and "active" in classes else "pager" if set(classes) & set(PAGER_CLASSES) else None
        if role in self.closed or role in self.found:
            role = None
        if role:
            self.found[role] = []
        if tag not in VOID:
            self.open.append((tag, role))

    def handle_endtag(self, tag):
        while self.open:
            name, role = self.open.pop()
            if role:
                self.closed.add(role)
            if name == tag:
                break

    def handle_data(self, data):
        for _, role in self.open:
            if role:
                self.found[role].append(data)


def active_page(page: str) -> int | None:
    """The number of a listing's page: the first of its active element, else the last of its
    pager; None without either."""
    p = _Pager()
    p.feed(page)
    for role, which in (("active", 0), ("pager", -1)):
        numbers = _NUMBER.findall(" ".join(p.found.get(role, ())))
        if numbers:
            return int(numbers[which])
    return None


def listing(get: Callable[[str], str | None], base: str, pattern: str, max_pages: int = 50, page_url: str = "{base}?page={n}") -> list[str]:
    """Distinct links of a paged listing that match ``pattern``, in the order they come.

    Pages are read one after another: a page without a new link, one that is another than the
    one asked for (sites answer past the end with their last page), a missing one, or
    ``max_pages`` ends it.
    """
    found: dict[str, None] = {}
    for n in range(1, max_pages + 1):
        url = base if n == 1 else page_url.format(base=base, n=n)
        page = get(url)
        if page is None or n > 1 and active_page(page) not in (None, n):
            break
        links = [urljoin(url, x) for x in read_html(page)["links"]]
        new = [x for x in dict.fromkeys(links) if re.search(pattern, x) and x not in found]
        if not new:
            break
        found.update(dict.fromkeys(new))
    return list(found)


Handler = Callable[[dict, Callable[[str], "str | None"]], list[Discovered]]
HANDLERS: dict[str, Handler] = {}


def handler(name: str):
    """Decorator: a source handler under a name; a name that is taken is an error."""

    def add(run: Handler) -> Handler:
        if name in HANDLERS:
            raise ValueError(f"{name!r} is registered already")
        HANDLERS[name] = run
        return run

    return add


@handler("single")
def single(source: dict, get) -> list[Discovered]:
    """A source that is one document at its own address."""
    return [Discovered(source["code"], source["code"], source["base_url"], source.get("kind"))]


@handler("paged")
def paged(source: dict, get) -> list[Discovered]:
    """A source with a paged listing of documents; the id is the last part of an address."""
    links = listing(get, source["base_url"], source.get("pattern") or ".", source.get("max_pages") or 50)
    return [Discovered(source["code"], [x for x in re.split("[/?=&]", u) if x][-1], u, source.get("kind")) for u in links]


def discovered(source: dict, get: Callable[[str], "str | None"]) -> list[Discovered]:
    """What the source's handler finds; an unknown handler is an error."""
    name = source.get("handler") or "single"
    if name not in HANDLERS:
        raise ValueError(f"no handler {name!r}; there are {', '.join(sorted(HANDLERS))}")
    return HANDLERS[name](source, get)


_ANSWER = "url string, status_code int, body binary, etag string, last_mod string, error string"


def fetched(rows: DataFrame, client: Callable[[str, str | None, str | None], tuple]) -> DataFrame:
    """(url, status_code, body, etag, last_mod, error) of ``rows (url, etag, last_mod)``.

    ``client(url, etag, last_mod) -> (status, body, etag, last_mod)`` asks conditionally; of
    "not modified" there is no body and the old validators stay.  Addresses of one host are
    asked one after another by one task; what raises is an error of its own row.
    """
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url, etag, last in frame[["url", "etag", "last_mod"]].astype(object).where(frame.notna(), None).itertuples(index=False):
                try:
                    status, body, new_etag, new_last = client(url, etag, last)
                    kept = status == 304
                    out.append((url, status, None if kept else body, new_etag or (etag if kept else None), new_last or (last if kept else None), None))
                except Exception as failure:  # noqa: BLE001 - a failing address is data here
                    out.append((url, None, None, etag, last, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(out, columns=["url", "status_code", "body", "etag", "last_mod", "error"]).astype({"status_code": "Int64"})

    host = F.try_parse_url("url", F.lit("HOST"))
    return rows.select("url", "etag", "last_mod").repartition(host).mapInPandas(run, _ANSWER)
