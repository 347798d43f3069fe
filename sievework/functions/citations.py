"""Citation marks such as [3] in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import html_escape, strip

MARK = r"\[(\d+)\]"
# The heading of a section of sources that the answer wrote itself, which goes with
# all that follows; the date in a document's id; titles that name no document.
OWN_SOURCES = r"(?is)\n[\s*#>\-]*(?:[0-9]+[.)]\s*)?(?:\*\*)?источник[\p{L}\p{N}_]*(?:\*\*)?\s*[:.]?\s*(?:\n|$).*$"
SLUG_DATE = r"ot[_-]([0-9]{2}\.[0-9]{2}\.[0-9]{2,4})"
GENERIC_TITLES = ("", "минфин", "российская федерация", "фнс")
LONGEST_TITLE, NO_NAME = 80, "Источник"


def numbers(answer: Column) -> Column:
    """array<int> of cited numbers in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(MARK), F.lit(1)), lambda x: x.try_cast("int"))


def present(answer: Column) -> Column:
    return (F.size(numbers(answer)) > 0).cast("double")


def valid_share(answer: Column, sources: Column) -> Column:
    """Share of citations that name one of ``sources`` sources; 0 without citations."""
    cited = numbers(answer)
    good = F.filter(cited, lambda n: (n >= 1) & (n <= sources))
    return F.when(F.size(cited) > 0, F.size(good) / F.size(cited)).otherwise(F.lit(0.0))


def density(answer: Column) -> Column:
    """Citations for 1000 characters."""
    return F.size(numbers(answer)) * 1000.0 / F.greatest(F.length(F.coalesce(answer, F.lit(""))), F.lit(1))


def used(answer: Column, sources: Column) -> Column:
    """Distinct valid numbers, in the order they are first cited."""
    return F.filter(F.array_distinct(numbers(answer)), lambda n: (n >= 1) & (n <= sources))


def renumbered(answer: Column, sources: Column) -> Column:
    """The answer with its valid citations numbered 1.. in order of first use; others stay as
    they are written."""
    order = used(answer, sources)
    between = F.split(answer, MARK, -1)
    marks = F.regexp_extract_all(answer, F.lit(MARK), F.lit(0))
    place = lambda m: F.array_position(order, F.regexp_extract(m, MARK, 1).try_cast("int"))
    new = F.transform(marks, lambda m: F.when(place(m) > 0, F.concat(F.lit("["), place(m).cast("string"), F.lit("]"))).otherwise(m))
    return F.array_join(F.zip_with(between, new, lambda text, mark: F.concat(text, F.coalesce(mark, F.lit("")))), "")


def without_own_sources(answer: Column) -> Column:
    return F.regexp_replace(answer, OWN_SOURCES.replace("(?is)", "(?isu)"), "")


def source_name(source: Column, names: Column | None = None, titled: tuple[str, ...] = ()) -> Column:
    """The name of a source: its display name, with the date in the document's id and, for
    ``titled`` sources, a title that says something.

    ``source``: struct of source_code, external_id, title; ``names``: map of code to name.
    """
    code = F.coalesce(source["source_code"], F.lit(""))
    base = F.coalesce(F.nullif(code, F.lit("")), F.lit(NO_NAME))
    if names is not None:
        base = F.coalesce(F.nullif(names[code], F.lit("")), base)
    day = F.nullif(F.regexp_extract(F.coalesce(source["external_id"], F.lit("")), SLUG_DATE, 1), F.lit(""))
    title = strip(F.coalesce(source["title"], F.lit("")))
    fine = code.isin(*titled) & ~F.lower(title).isin(*GENERIC_TITLES) & (F.length(title) <= LONGEST_TITLE) if titled else F.lit(False)
    extras = F.filter(F.array(F.concat(F.lit("от "), day), F.when(fine, title)), lambda x: x.isNotNull())
    return F.when(F.size(extras) > 0, F.concat(base, F.lit(" ("), F.array_join(extras, "; "), F.lit(")"))).otherwise(base)


def source_url(source: Column, bases: Column | None = None) -> Column:
    """The document's address, else that of its source (``bases``: map of code to address)."""
    own = F.nullif(source["canonical_url"], F.lit(""))
    return own if bases is None else F.coalesce(own, F.nullif(bases[F.coalesce(source["source_code"], F.lit(""))], F.lit("")))


def source_line(number: Column, name: Column, url: Column, html: bool = False) -> Column:
    """``[n] name`` with the address on a line below, or with the name as a link to it."""
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "))
    known = url.isNotNull() & (url != "")
    if html:
        return F.concat(head, F.when(known, F.concat(F.lit('<a href="'), html_escape(url), F.lit('">'), html_escape(name), F.lit("</a>"))).otherwise(html_escape(name)))
    return F.concat(head, name, F.when(known, F.concat(F.lit("\n   "), url)).otherwise(F.lit("")))
