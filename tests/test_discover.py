import pytest

from sievework.operators import discover as d


def page(n, links, shown=None):
    items = "".join(f'<a href="{x}">x</a>' for x in links)
    return f'<html><body>{items}<ul class="pagination"><li>1</li><li class="active"><a>{shown or n}</a></li><li>9</li></ul></body></html>'


def test_active_page():
    assert d.active_page(page(3, [])) == 3
    assert d.active_page('<div class="pager"><a>1</a> <a>2</a> <b>7</b></div>') == 7
    assert d.active_page("<p>12</p>") is None


def test_listing_stops():
    pages = {"http://a/l": page(1, ["/doc/1", "/about", "/doc/2", "/doc/1"]), "http://a/l?page=2": page(2, ["/doc/2", "/doc/3"]), "http://a/l?page=3": page(3, ["/doc/3"]), "http://a/l?page=4": page(4, ["/doc/9"])}
    docs = lambda n: [f"http://a/doc/{i}" for i in range(1, n + 1)]
    assert d.listing(pages.get, "http://a/l", "/doc/") == docs(3)  # the third page adds nothing
    assert d.listing(pages.get, "http://a/l", "/doc/", max_pages=1) == docs(2)
    past = pages | {"http://a/l?page=2": page(2, ["/doc/5"], shown=1)}  # the last page again
    assert d.listing(past.get, "http://a/l", "/doc/") == docs(2)
    assert d.listing({}.get, "http://a/l", "/doc/") == []


def test_handlers():
    pages = {"http://a/l": page(1, ["/doc/1?id=7"])}
    assert d.discovered({"code": "s", "base_url": "http://a/l", "handler": "paged", "pattern": "/doc/", "kind": "law"}, pages.get) == [d.Discovered("s", "7", "http://a/doc/1?id=7", "law")]
    assert d.discovered({"code": "s", "base_url": "http://a/x", "handler": ""}, pages.get) == [d.Discovered("s", "s", "http://a/x", None)]
    with pytest.raises(ValueError):
        d.discovered({"code": "s", "handler": "absent"}, pages.get)


def test_conditional_fetch(spark):
    def client(url, etag, last):
        if url.endswith("bad"):
            raise OSError("down")
        return (304, b"x", None, None) if etag == "e" else (200, b"body", "new", None)

    rows = spark.createDataFrame([("http://a/1", "e", "m"), ("http://a/2", None, None), ("http://b/bad", "k", None)], "url string, etag string, last_mod string")
    got = {r.url: tuple(r)[1:] for r in d.fetched(rows, client).collect()}
    assert got == {"http://a/1": (304, None, "e", "m", None), "http://a/2": (200, bytearray(b"body"), "new", None, None), "http://b/bad": (None, None, "k", None, "OSError: down")}
