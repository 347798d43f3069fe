import hashlib

import numpy as np
import pytest

from sievework.llm import encoding as e

SCHEMA = "doc_id bigint, source_code string, text string"
WORDS = "налог ставка организация договор срок уплата вычет расход доход имущество заявитель представляет декларацию по адресу регистрации если счет заблокирован без решения инспекции и документы получены вовремя".split()


def prose(seed, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 8):
        s = " ".join(rng.choice(WORDS, 8))
        out.append(s[0].upper() + s[1:] + ".")
    return " ".join(out) + "\nПисьмо от 12.03.2024 № 5 «Ответ»."


def garble(text, page, read_as):
    return "".join(e.char_of(read_as)[b] for b in text.encode(page, "replace"))


CASES = {"koi": ("koi8-r", "cp1251"), "win": ("cp1251", "koi8-r"), "dos": ("cp866", "cp1251"), "box": ("cp1251", "cp866"), "utf": ("utf-8", "cp1251"), "lat": ("cp1251", "latin-1"), "utl": ("utf-8", "latin-1")}


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"s{i % 2}", prose(i)) for i in range(120)]
    for k, (page, read_as) in enumerate(CASES.values()):
        out.append((1000 + k, "s0", garble(prose(1000 + k), page, read_as)))
        good = prose(2000 + k)
        out.append((2000 + k, "s1", good + "\n" + garble(prose(3000 + k, 16).replace("№", "N"), page, read_as) + "\n" + good))
    out += [(3000, "s0", prose(7).replace("о", "�")), (3001, "s0", "".join("?" if c.isalpha() else c for c in prose(8)))]
    # Not cases: other languages and alphabets, odd spaces, a byte-order mark, decomposed accents.
    out += [(4000, "s0", "Der Vertrag gilt für das laufende Jahr und wird schriftlich bestätigt."), (4001, "s0", "﻿" + prose(9)), (4002, "s1", prose(10).replace(" ", " ")), (4003, "s1", prose(11).replace("й", "й")), (4004, "s1", prose(12) + " Что это значит???"), (4005, "s0", None), (4006, "s0", ""), (None, "s0", "РџСЂРёРІРµС‚")]
    return out


def test_found(spark, rows):
    got = {r.doc_id for r in e.garbled_records(spark.createDataFrame([*rows, rows[121]], SCHEMA)).collect()}
    assert got == {r[0] for r in rows if r[0] is not None and 1000 <= r[0] < 4000}


def test_restored_round_trip(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", lost int")
    served = [(1000 + k, hashlib.sha256(prose(1000 + k).encode()).hexdigest()) for k in range(len(CASES))]
    out = {r.doc_id: r for r in e.restored_texts(df, spark.createDataFrame(served, "doc_id bigint, body_sha256 string")).collect()}
    for k, (name, (page, read_as)) in enumerate(CASES.items()):
        whole = e.undo(garble(prose(1000 + k), page, read_as), (page, read_as))
        assert out[1000 + k].text == whole, name
        assert out[1000 + k].confirmed == (whole == prose(1000 + k))
    assert out[1004].confirmed and out[3000].lost > 0


def test_empty(spark):
    assert e.garbled_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_learning_needs_no_known_page():
    """A substitution nobody named is learnt from bigrams alone."""
    import pandas as pd

    counts = np.zeros(e.CLASSES**2, np.int64)
    for i in range(400):
        e.ordinary_bigrams(prose(i), counts)
    rng = np.random.default_rng(5)
    letters = list(e.RUSSIAN)
    secret = dict(zip(letters, rng.permutation([chr(0x10A0 + i) for i in range(33)])))
    text = " ".join("".join(secret.get(c, " ") for c in prose(5000 + i).lower()) for i in range(150))
    pairs = pd.Series(list(zip(text, text[1:]))).value_counts()
    frame = pd.DataFrame([(a, b, n) for (a, b), n in pairs.items()], columns=["s1", "s2", "n"])
    learnt = e.learn(frame, e.Language(counts).hidden(), None, rounds=200)
    plain = text.translate({ord(k): v for k, v in learnt.items() if v})
    right = "".join({v: k for k, v in secret.items()}.get(c, c) for c in text)
    known = [a == b for a, b in zip(plain, right) if not b.isspace()]
    assert sum(known) / len(known) > 0.8


UNLISTED = (("cp1251", "cp855"), ("cp855", "cp1251"), ("cp1251", "cp1253"), ("koi8-r", "cp1253"))


def swapped(text, page, read_as):
    """As ``garble``; characters the page lacks stay, bytes nobody reads are left out."""
    out = []
    for ch in text:
        try:
            out.append(ch if ch < "\x80" else ch.encode(page).decode(read_as))
        except UnicodeEncodeError:
            out.append("N")
        except UnicodeDecodeError:
            pass
    return "".join(out)


@pytest.fixture(scope="module")
def unlisted(spark):
    """Whole texts and single sentences of four sources under pages that no chain names."""
    table = spark.read.parquet("/root/testdata/sf0.01/local_document.parquet").select("doc_id", "source_code", "text").dropDuplicates(["doc_id"])
    before = {r.doc_id for r in e.garbled_records(table).collect()}
    rows = [tuple(r) for r in table.collect()]
    sizes = {s: sum(r[1] == s for r in rows) for s in {r[1] for r in rows}}
    sources = sorted(sizes, key=lambda s: (-sizes[s], s))[: len(UNLISTED)]
    planted, out = {}, []
    for doc, source, text in rows:
        if source in sources and text and doc not in before:
            page, read_as = UNLISTED[sources.index(source)]
            n = sum(p[0] == source for p in planted.values())
            cyrillic = sum("а" <= c <= "я" for c in text.lower()) > 0.5 * len(text)
            if n < 15 and len(text) > 600 and cyrillic:
                planted[doc] = (source, text, page, read_as)
                text = swapped(text, page, read_as)
            elif n < 25 and len(text) > 600 and cyrillic:  # a short stretch, read by what whole texts taught
                planted[doc] = (source, text, page, read_as)
                lines = text.split("\n")
                k = max(range(len(lines)), key=lambda i: len(lines[i]))
                words = lines[k].split(" ")
                words[2:7] = swapped(" ".join(words[2:7]), page, read_as).split(" ")
                lines[k] = " ".join(words)
                text = "\n".join(lines)
        out.append((doc, source, text))
    return before, planted, spark.createDataFrame(out, SCHEMA)


def test_unlisted_pages_are_learnt(unlisted):
    before, planted, table = unlisted
    got = {r.doc_id: r.text for r in e.restored_texts(table).collect()}
    whole = set(planted)
    hit = whole & set(got)
    assert len(hit) >= 0.9 * len(whole), (len(hit), len(whole))
    assert len(set(got) - before - whole) <= 0.1 * len(whole)
    right = letters = 0
    for d in hit:
        _, text, page, read_as = planted[d]
        # Words keep their places; a byte nobody reads is lost and does not count.
        for old, new in zip(text.split(" "), got[d].split(" ")):
            want = [c for c in old if c.lower() in e.RUSSIAN and (old == new or swapped(c, page, read_as))]
            have = [c for c in new if c.lower() in e.RUSSIAN]
            letters += len(want)
            right += sum(a == b for a, b in zip(want, have)) if len(want) == len(have) else 0
    assert right >= 0.95 * letters, right / letters


def test_undo_is_the_inverse():
    for page, read_as in CASES.values():
        text = prose(1).replace("№", "N").replace("«", '"').replace("»", '"')
        assert e.undo(garble(text, page, read_as), (page, read_as)) == text
