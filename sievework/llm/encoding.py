"""Text that was read with a wrong character encoding.

Four passes, of which only the first two read all texts:

1. Letter bigrams of the language are counted over all lines that look ordinary.
2. Stretches of words that the bigrams find much less likely than chance are cut out, with
   the places where letters were replaced by stand-in characters.
3. A stretch is a cipher text: a code-page swap replaces every letter by another symbol (one
   character, or the two or four that one letter became).  Stretches that a known chain of
   pages makes language of are pooled by source and chain, all others by source and the script
   of their symbols.  The symbol bigrams of each pool are summed up, and
   expectation-maximization against the language bigrams learns which letter each symbol stands
   for, from the known chain where there is one, else freely.
4. The learnt mapping is applied; a stretch is a case if its letters then read as language.  A
   free mapping must first be confirmed: it must make language of its whole pool, nearly one
   symbol for one letter.  Then it is tried on every unexplained stretch of the source, however
   short.  Where learnt letters agree with a pair of code pages, that pair also gives the
   symbols too rare to be learnt (capitals, quotes, digits' signs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.durable import durable, tune_arrow
from sievework.sources import with_columns

# Alphabets.
RUSSIAN = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
LATIN = "abcdefghijklmnopqrstuvwxyz"
MORE_CYRILLIC = "іїєґўђѓѕјљњћќџәғқңөұүһӣӯ"
MORE_LATIN = "".join(map(chr, range(0xDF, 0x100))) + "āăąćčďđēęěğģīįıķĺľłńňőœřśşšţťūůűųźżžƒ"
#: Signs of ordinary typography: they separate words and speak for no encoding.
SIGNS = "«»„“”‚‘’‹›–—…№§©®°·•→←↑↓−×€™ ­﻿​‌‍    ̧̀́̆̈̂̃̌"

LETTERS = "\0" + RUSSIAN + LATIN + MORE_CYRILLIC + MORE_LATIN
ODD = len(LETTERS)  # the class of every other character
CLASSES = ODD + 1
RU = len(RUSSIAN) + 1  # classes 0 (no letter) to 33 are the hidden alphabet
#: A stretch begins and ends where this many nats are gained against the language.
SWITCH = 6.0
#: A text with no run this much less likely than chance has no stretch.
SUSPECT = 9.0
#: Nats that reading a stretch through the mapping must gain, in all and for each letter.
GAIN, GAIN_PER_LETTER = 8.0, 0.7
CHANCE = -log(45)
#: Mappings (some kilobytes each) that are sent to every executor; more are joined by key.
FEW_MAPPINGS = 3_000


@lru_cache(1)
def class_table() -> np.ndarray:
    """uint8 for every code point below 0x10000 and one more for all above."""
    table = np.full(0x10001, ODD, np.uint8)
    table[:0x80] = 0
    for ch in SIGNS:
        table[ord(ch)] = 0
    for i, ch in enumerate(LETTERS):
        table[ord(ch)] = i
        if len(up := ch.upper()) == 1:
            table[ord(up)] = i
    return table


@lru_cache(1)
def case_table() -> np.ndarray:
    """1 lower, 2 upper case, 0 neither."""
    table = np.zeros(0x10001, np.uint8)
    for i in range(0x2000):
        ch = chr(i)
        table[i] = 1 if ch.islower() else 2 if ch.isupper() else 0
    return table


def code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)


def ordinary_bigrams(text: str, counts: np.ndarray) -> None:
    """Adds the bigrams of the text's ordinary lines to ``counts`` (CLASSES²)."""
    code = code_points(text)
    if len(code) < 20:
        return
    c, case = class_table()[code], case_table()[code]
    ends = np.flatnonzero(code == 10)
    starts = np.concatenate(([0], ends + 1))
    starts = starts[starts < len(code)]
    letter = c > 0
    n = np.add.reduceat(letter.astype(np.int32), starts)
    upper = np.add.reduceat((case == 2).astype(np.int32), starts)
    odd = np.add.reduceat((c == ODD).astype(np.int32), starts)
    accented = np.add.reduceat((c >= ODD - len(MORE_LATIN)).astype(np.int32), starts)
    turn = np.zeros(len(code), np.int32)
    turn[1:] = (case[:-1] == 1) & (case[1:] == 2)
    turns = np.add.reduceat(turn, starts)
    good = (n >= 20) & (odd == 0) & (turns == 0) & (upper < 0.4 * n) & (accented < 0.2 * n)
    if not good.any():
        return
    use = np.repeat(good, np.diff(np.append(starts, len(code))))
    pair = c[:-1].astype(np.int32) * CLASSES + c[1:]
    counts += np.bincount(pair[use[1:] & use[:-1]], minlength=CLASSES * CLASSES)


class Language:
    """Bigram model: log P(next class | class), from counts over all ordinary lines."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(CLASSES, CLASSES).astype(float)
        n = self.counts.copy()
        n[0, 0] = 0  # between words nothing is said
        total = n.sum(0) + 1.0
        back = total / total.sum()
        weight = 20.0
        p = (n + weight * back) / (n.sum(1, keepdims=True) + weight)
        self.logp = np.log(p)
        self.logp[0, 0] = 0.0
        seen = n.sum() or 1.0
        self.usual = float((n * self.logp).sum() / seen)
        # The same for each letter, as scores of whole texts are divided.
        self.per_letter = float((n * self.logp).sum() / (n[:, 1:].sum() or 1.0))
        # What each step speaks against the language, more than a few nats counting as few.
        self.against = np.minimum(CHANCE - self.logp, 8.0).astype(np.float32)
        self.against[0, 0] = 0.0

    def score(self, text: str) -> tuple[float, int]:
        """Log likelihood and number of letters."""
        c = class_table()[code_points(" " + text + " ")]
        return float(self.logp[c[:-1], c[1:]].sum()), int((c > 0).sum())

    def hidden(self) -> np.ndarray:
        """Joint probabilities of the hidden alphabet's bigrams."""
        n = self.counts[:RU, :RU] + 0.05
        n[0, 0] = n[0, 1:].sum() * 0.1
        return n / n.sum()


#: No-break spaces do not end a word: a letter read wrongly may have become one.
_TOKEN = re.compile(r"[^ \t\r\n]+")
#: Letters of UTF-8 read as single bytes: too short for the bigrams when only a sign is hit.
_LEAD = re.compile("[ÐÑÃÂâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|вЂ.|[РС][\u0080-¿€‚ѓ„…†‡‰Љ‹ЊЌЋЏђ‘’“”•–—™љ›њќћџЎўЈ¤Ґ¦§Ё©Є«¬®Ї°±Ііґµ¶·ё№є»јЅѕї][РС]")
_LOST = re.compile("�|[А-Яа-яЁё]\\?[а-яё]")
_MARKS = re.compile(r"(?<!\S)[^\w\s?]*\?[?]+[^\w\s?]*(?!\S)")


def lost_letters(text: str) -> int:
    """How many stand-in characters took the place of letters."""
    if "�" not in text and "?" not in text:
        return 0
    n = sum(1 for _ in _LOST.finditer(text))
    # Words of question marks alone: one such word may be an exclamation, a run of them isn't.
    words = [m.group().count("?") for m in _MARKS.finditer(text)]
    if len(words) >= 3 and sum(words) >= 8:
        n += sum(words)
    return n


def stretches(text: str, lang: Language) -> list[tuple[int, int]]:
    """(start, end) of the runs of words that don't read as language."""
    if len(text) < 4:
        return []
    c = np.zeros(len(text) + 2, np.int32)
    c[1:-1] = class_table()[code_points(text)]
    total = np.cumsum(lang.against.ravel()[c[:-1] * CLASSES + c[1:]], dtype=np.float64)
    led = bool(_LEAD.search(text))
    if not led and (total - np.minimum.accumulate(total)).max() < SUSPECT:
        return []
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    total = np.concatenate(([0.0], total))
    # The word's letters with the steps into and out of it.
    llr = [float(total[e + 1] - total[s]) for s, e in spans]
    clean, garbled, back = 0.0, -SWITCH, []
    for x in llr:
        a, b = clean, garbled
        to_clean = b > a
        to_garbled = a - SWITCH > b
        back.append((to_clean, to_garbled))
        clean = max(a, b)
        garbled = max(b, a - SWITCH) + x
    state, marks = garbled > clean, []
    for to_clean, to_garbled in reversed(back):
        marks.append(state)
        state = (not to_garbled) if state else to_clean
    marks.reverse()
    if led:
        marks = [m or bool(_LEAD.search(text, a, b)) for m, (a, b) in zip(marks, spans)]
    out, i = [], 0
    while i < len(spans):
        if not marks[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(spans) and marks[j + 1]:
            j += 1
        out.append((spans[i][0], spans[j][1]))
        i = j + 1
    return out


# Known code pages, each as the encoding of the bytes and the one they were read with.
PAGES = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
READ_AS = (*PAGES, "latin-1", "cp1252")
CHAINS = [*((a, b) for a in ("utf-8", *PAGES) for b in READ_AS if a != b), ("utf-8", "cp1251", "utf-8", "cp1251"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("utf-8", "latin-1", "utf-8", "latin-1")]
CHAIN_NAMES = [">".join(c) for c in CHAINS]


@lru_cache(None)
def byte_of(page: str) -> dict[int, int]:
    """Code point to byte; positions a page leaves open are read as the control of that number."""
    table = {i: i for i in range(0x80, 0xA0)}
    for i in range(256):
        try:
            table[ord(bytes([i]).decode(page))] = i
        except UnicodeDecodeError:
            pass
    return table


@lru_cache(None)
def char_of(page: str) -> list[str]:
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(i))
    return out


@lru_cache(None)
def swap_table(page: str, read_as: str) -> dict[int, str]:
    """For translate(): what each character read with ``read_as`` is in ``page``."""
    return {point: char_of(page)[byte] for point, byte in byte_of(read_as).items() if byte >= 0x80}


class _Bytes(dict):
    """For translate(): characters to the bytes of a page, each byte as the character of that
    number; what the page lacks becomes its own UTF-8."""

    def __init__(self, page: str):
        super().__init__({point: chr(byte) for point, byte in byte_of(page).items()})

    def __missing__(self, point: int) -> str:
        raw = self[point] = chr(point).encode("utf-8", "surrogatepass").decode("latin-1")
        return raw


@lru_cache(None)
def _bytes_of(page: str) -> _Bytes:
    return _Bytes(page)


def undo(text: str, chain: tuple[str, ...]) -> str:
    """The text before the swaps of ``chain``; what a swap cannot have made stays as it is."""
    for page, read_as in reversed(list(zip(chain[::2], chain[1::2]))):
        if page != "utf-8":
            text = text.translate(swap_table(page, read_as))
        else:
            text = text.translate(_bytes_of(read_as)).encode("latin-1").decode("utf-8", "replace")
    return text


def units(text: str, chain: tuple[str, ...]) -> list[str]:
    """The text as symbols: what one letter became under ``chain``."""
    parts, chars = list(text), list(text)
    for page, read_as in reversed(list(zip(chain[::2], chain[1::2]))):
        if page != "utf-8":
            continue  # one character for each
        table = byte_of(read_as)
        raw = [table.get(ord(ch), 0) for ch in chars]
        joined, plain, i = [], [], 0
        while i < len(chars):
            b = raw[i]
            n = 1 if b < 0xC2 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
            if n > 1 and not all(0x80 <= x < 0xC0 for x in raw[i + 1 : i + n]):
                n = 1
            whole = bytes(raw[i : i + n]).decode("utf-8", "ignore") if n > 1 else chars[i]
            joined.append("".join(parts[i : i + n]))
            plain.append(whole if len(whole) == 1 else chars[i])
            i += n
        parts, chars = joined, plain
    return parts


@lru_cache(None)
def class_after(page: str, read_as: str) -> np.ndarray:
    """The letter class of what each code point is after undoing one single-byte swap."""
    table = class_table().copy()
    for point, ch in swap_table(page, read_as).items():
        table[point] = class_table()[min(ord(ch), 0x10000)]
    return table


@lru_cache(None)
def lead_table(read_as: str) -> np.ndarray:
    """True for the code points that are leading bytes of UTF-8 when read with ``read_as``."""
    table = np.zeros(0x10001, bool)
    for point, byte in byte_of(read_as).items():
        table[point] = 0xC2 <= byte <= 0xEF
    return table


def best_chain(text: str, lang: Language) -> tuple[int, float]:
    """The known chain that reads best, and the nats it gains; -1 if none gains anything.

    Single-byte swaps are scored on the stretch's distinct bigrams; swaps of UTF-8 only where
    a fourth or more of the foreign characters can be leading bytes.
    """
    code = code_points(" " + text + " ")
    pair, n = np.unique(code[:-1].astype(np.int64) * 0x10001 + code[1:], return_counts=True)
    left, right = pair // 0x10001, pair % 0x10001
    table = class_table()
    raw = float((n * lang.logp[table[left], table[right]]).sum())
    foreign = code[code >= 0x80]
    best, gain = -1, 0.0
    if not len(foreign):
        return best, gain
    for i, chain in enumerate(CHAINS):
        if "utf-8" not in chain:
            after = class_after(*chain)
            g = float((n * lang.logp[after[left], after[right]]).sum()) - raw
        else:
            share = lead_table(chain[-1])[foreign].mean()
            if share < 0.25:
                continue
            plain = undo(text, chain)
            if plain == text:
                continue
            g = lang.score(plain)[0] - raw - 4.0 * plain.count("�")
        if g > gain:
            best, gain = i, g
    return best, gain


def alphabetic(text: str) -> int:
    """Letters of the known alphabets."""
    c = class_table()[code_points(text)]
    return int(((c > 0) & (c < ODD)).sum())


def trimmed(text: str, start: int, stop: int, chain: int, lang: Language) -> tuple[int, int]:
    """The stretch without words at its ends that the chain does not make any likelier."""
    spans = [(start + a, start + b) for a, b in (m.span() for m in _TOKEN.finditer(text[start:stop]))]

    def better(span: tuple[int, int]) -> bool:
        word = text[span[0] : span[1]]
        plain = undo(word, CHAINS[chain])
        # Signs in place of letters are likelier too, but no reading.
        loses = "utf-8" not in CHAINS[chain] and alphabetic(plain) < alphabetic(word)
        return plain != word and not loses and lang.score(plain)[0] > lang.score(word)[0]

    while spans and not better(spans[0]):
        spans.pop(0)
    while spans and not better(spans[-1]):
        spans.pop()
    return (spans[0][0], spans[-1][1]) if spans else (start, stop)


#: Symbols of a pool that are learnt, the most frequent first; a single-byte page has 128.
SYMBOLS = 512
_SPACES = " \t\r\n"


def _symbol_matrix(pairs: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The symbols and their bigram counts; white space comes first."""
    seen = pd.concat([pairs[["s1", "n"]].set_axis(["s", "n"], axis=1), pairs[["s2", "n"]].set_axis(["s", "n"], axis=1)]).groupby("s").n.sum()
    spaces = [x for x in seen.index if x in _SPACES]
    symbols = spaces + sorted(seen.drop(spaces).sort_values(ascending=False, kind="stable").index[:SYMBOLS])
    at = {x: i for i, x in enumerate(symbols)}
    use = pairs[pairs.s1.isin(at) & pairs.s2.isin(at)]
    n = np.zeros((len(symbols), len(symbols)))
    np.add.at(n, (use.s1.map(at).to_numpy(int), use.s2.map(at).to_numpy(int)), use.n.to_numpy(float))
    return symbols, n


def learn(pairs: pd.DataFrame, hidden: np.ndarray, chain: tuple[str, ...] | None, rounds: int = 40) -> dict[str, str]:
    """Symbol to letter by expectation-maximization on symbol bigrams (s1, s2, n).

    Pairwise form: every bigram's posterior over hidden bigrams under ``hidden``; the emission
    starts from a known chain where there is one, else from ranks of frequency.  Of several
    symbols for one letter those that mostly begin words are its capital.
    """
    symbols, n = _symbol_matrix(pairs)
    emit = np.full((RU, len(symbols)), 1e-3)
    if chain:
        for i, s in enumerate(symbols):
            k = (RUSSIAN.find(undo(s, chain).lower()) + 1) if len(undo(s, chain)) == 1 else 0  # 0: no letter
            emit[k, i] += 1.0
    else:
        by_rank = np.argsort(-n.sum(1))
        likely = np.argsort(-hidden.sum(1))
        for r, i in enumerate(by_rank):
            for near in range(max(0, r - 4), min(RU, r + 5)):
                emit[likely[near], i] += 1.0 / (1 + abs(near - r))
            if ord(symbols[i][0]) < 0x80:  # pages agree below 128: no letter of the cipher
                emit[:, i] = 1e-6
                emit[0, i] = 1.0
    # A known chain weighs as much as so many sightings of each symbol; a short stretch cannot
    # overrule it, a source's worth of text can.
    prior = 5.0 * emit if chain else np.full_like(emit, 1e-6)
    emit = emit / emit.sum(1, keepdims=True)
    for _ in range(rounds):
        ratio = n / np.maximum(emit.T @ hidden @ emit, 1e-300)
        first = emit * (hidden @ emit @ ratio.T)
        second = emit * (hidden.T @ emit @ ratio)
        sightings = first + second + prior
        emit = sightings / sightings.sum(1, keepdims=True)
    top = sightings.argmax(0)
    seen = n.sum(0)
    first = n[[i for i, s in enumerate(symbols) if s in _SPACES]].sum(0)
    out = {}
    for i, s in enumerate(symbols):
        letter = RUSSIAN[top[i] - 1] if top[i] else ""
        rarer = (top == top[i]) & (seen > seen[i])
        out[s] = letter.upper() if letter and rarer.any() and 2 * first[i] > seen[i] else letter
    return out


#: Letters a pool must have before a mapping can be learnt from nothing, how far the pool may
#: then be from ordinary text (nats a letter), and the most of it that may be symbols which
#: share their letter with a commoner one (capitals are such).
POOL_LETTERS, POOL_FIT, POOL_SHARED = 400, 0.5, 0.15


def pool_of(piece: str) -> int | None:
    """-1 and below: the pool of a stretch no known chain reads, by the script of its symbols.

    Pages agree below 128, so a stretch with few other characters is no cipher: None.
    """
    code = code_points(piece)
    code = code[code > 0x20]
    foreign = code[code >= 0x80]
    if 2 * len(foreign) < len(code) or not len(foreign):
        return None
    script = np.select([(foreign >= 0x400) & (foreign < 0x530), (foreign >= 0x370) & (foreign < 0x400), foreign < 0x250, (foreign >= 0x2500) & (foreign < 0x2600)], [0, 1, 2, 3], 4)
    return -1 - int(np.bincount(script).argmax())


def confirmed(pairs: pd.DataFrame, mapping: dict[str, str], lang: Language) -> bool:
    """Whether a freely learnt mapping makes language of the pool it was learnt from."""
    symbols, n = _symbol_matrix(pairs)
    letters = [mapping.get(s, "").lower() for s in symbols]
    c = np.array([RUSSIAN.index(x) + 1 if x else 0 for x in letters])
    seen, total = n.sum(0), float(n[:, c > 0].sum())
    if total < POOL_LETTERS:
        return False
    most = np.zeros(RU)
    np.maximum.at(most, c, seen)
    shared = 1.0 - most[1:].sum() / total
    kept = sum(x for x, s, to in zip(seen, symbols, letters) if to and s.lower() == to) / total
    return float((n * lang.logp[np.ix_(c, c)]).sum()) / total > lang.per_letter - POOL_FIT and shared <= POOL_SHARED and kept < 0.5


# Single-byte code pages that have the Russian letters, and those that others
# may have taken them for.
CYRILLIC_PAGES = ("cp1251", "koi8-r", "koi8-u", "cp866", "cp1125", "cp855", "iso8859-5", "mac-cyrillic", "ptcp154", "kz1048")
OTHER_PAGES = (
    "cp437", "cp720", "cp737", "cp775", "cp850", "cp852", "cp857", "cp858", "cp860", "cp861", "cp862", "cp863", "cp864", "cp865", "cp869", "cp874", "cp1250", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258",
    "latin-1", "iso8859-2", "iso8859-3", "iso8859-4", "iso8859-6", "iso8859-7", "iso8859-8", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16", "koi8-t", "mac-roman", "mac-greek", "mac-latin2", "mac-turkish", "hp-roman8",
)


def agreeing_pages(pairs: pd.DataFrame, mapping: dict[str, str], least: float = 0.85) -> tuple[str, str] | None:
    """The two code pages that give most of a pool's letters as learnt, if they give enough."""
    symbols, n = _symbol_matrix(pairs)
    held = [(ord(s), mapping[s].lower(), x) for s, x in zip(symbols, n.sum(0)) if mapping.get(s)]
    best, most = None, least * sum(x for _, _, x in held)
    for page in CYRILLIC_PAGES:
        for read_as in (*CYRILLIC_PAGES, *OTHER_PAGES):
            if page == read_as:
                continue
            table = swap_table(page, read_as)
            agreed = sum(n for s, x, n in held if table.get(s, "").lower() == x)
            if agreed > most:
                best, most = (page, read_as), agreed
    return best


def _bigram_table(texts: DataFrame) -> np.ndarray:
    """Bigram counts over the ordinary lines of all texts; at most CLASSES² rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for text in batch.column(0):
                ordinary_bigrams(text.as_py(), counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    rows = texts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES * CLASSES, np.int64)
    for r in rows:
        counts[r.at] = r.n
    return counts


_SEGMENTS = "doc_id bigint, source_code string, start int, stop int, piece string, chain int, lost int"


def _segments(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """The stretches of every text, and one row with ``lost`` > 0 where letters were lost.

    ``chain`` is the known chain that makes language of the stretch, else its pool.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = Language(counts)
        for batch in batches:
            out: list[tuple] = []
            for doc, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lost := lost_letters(text):
                    out.append((doc, source, 0, 0, "", -1, lost))
                for s, e in stretches(text, lang):
                    chain, _ = best_chain(text[s:e], lang)
                    if chain >= 0:
                        a, b = trimmed(text, s, e, chain, lang)
                        if is_case(text[a:b], read_words(text[a:b], CHAINS[chain]), lang, CHAINS[chain]):
                            out.append((doc, source, a, b, text[a:b], chain, 0))
                            continue
                    pool = pool_of(text[s:e])
                    if pool is not None:
                        out.append((doc, source, s, e, text[s:e], pool, 0))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "source_code", "start", "stop", "piece", "chain", "lost"])

    return texts.mapInArrow(run, _SEGMENTS)


def _symbol_bigrams(segments: DataFrame) -> DataFrame:
    """(source_code, chain, s1, s2, n) over all stretches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: dict[tuple, int] = {}
            for source, chain, piece in zip(frame.source_code, frame.chain, frame.piece):
                u = units(" " + piece + " ", CHAINS[chain] if chain >= 0 else ())
                for a, b in zip(u, u[1:]):
                    k = (source, chain, a, b)
                    counts[k] = counts.get(k, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["source_code", "chain", "s1", "s2", "n"])

    found = segments.filter("lost = 0").select("source_code", "chain", "piece").mapInPandas(run, "source_code string, chain int, s1 string, s2 string, n bigint")
    return found.groupBy("source_code", "chain", "s1", "s2").agg(F.sum("n").alias("n"))


_MAPPINGS = "source_code string, chain int, mapping map<string,string>, pages array<string>"


def learnt_mappings(segments: DataFrame, counts: np.ndarray) -> DataFrame:
    """(source_code, chain, mapping, pages): the letters learnt for each source and pool, and
    the code pages they agree with; pools whose mapping is not confirmed have no row.

    One group holds the bigrams of the symbols of one cipher, not its texts: its size is
    bounded by the square of the number of distinct characters.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        chain, lang = int(frame.chain.iloc[0]), Language(counts)
        out = pd.DataFrame({"source_code": [frame.source_code.iloc[0]], "chain": [chain]})
        known = CHAINS[chain] if chain >= 0 else None
        if not known and frame.n.sum() < POOL_LETTERS:
            return out.assign(mapping=[{}], pages=[[]]).iloc[:0]
        # Signs below 128 and white space stand for themselves.
        mapping = {s: x for s, x in learn(frame, lang.hidden(), known).items() if x and ord(s[0]) >= 0x80}
        if known:  # which symbols are letters the pages tell, which letter is learnt
            mapping = {s: x for s, x in mapping.items() if undone(s, known).lower() in RUSSIAN}
            return out.assign(mapping=[mapping], pages=[list(known)])
        return out.assign(mapping=[mapping], pages=[list(agreeing_pages(frame, mapping) or ())])[[confirmed(frame, mapping, lang)]]

    return _symbol_bigrams(segments).groupBy("source_code", "chain").applyInPandas(one, _MAPPINGS)


@lru_cache(100_000)
def undone(symbol: str, pages: tuple[str, ...]) -> str:
    return undo(symbol, pages)


def _learnt(symbol: str, known: str, mapping: dict[str, str]) -> str:
    """The letter learnt for a symbol, in the case the pages give it; else what they give."""
    letter = mapping.get(symbol)
    if not letter:
        return known
    return letter.upper() if known.isupper() else letter.lower()


def differing(piece: str, mapping: dict[str, str], pages: tuple[str, ...]) -> bool:
    """Whether the stretch has a symbol whose learnt letter is not the one of the pages."""
    return any(x.lower() != undone(u, pages).lower() and u in piece for u, x in mapping.items())


def read_words(piece: str, pages: tuple[str, ...], mapping: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(word, reading) of the words of a stretch that change: letters by the mapping, symbols
    it does not have by the pages."""
    words = _TOKEN.findall(piece)
    if not pages:
        table = {ord(k): v for k, v in mapping.items()}
        both = [(w, w.translate(table)) for w in words]
    elif mapping is None or not differing(piece, mapping, pages):
        plain = _TOKEN.findall(undo(piece, pages))  # at once: white space stays where it is
        both = list(zip(words, plain)) if len(plain) == len(words) else [(w, undo(w, pages)) for w in words]
    else:
        both = [(w, "".join(_learnt(u, undone(u, pages), mapping) for u in units(w, pages))) for w in words]
    return [(w, plain) for w, plain in both if plain != w]


def restored(piece: str, mapping: dict[str, str], pages: tuple[str, ...]) -> str:
    """The stretch through its pages where the learnt letters agree with them on four fifths of
    the stretch's letters, else letter by letter."""
    if not pages:
        return piece.translate({ord(k): v for k, v in mapping.items()})
    if differing(piece, mapping, pages):
        symbols = [(u, undone(u, pages)) for u in units(piece, pages)]
        judged = [(mapping.get(u, "").lower(), k.lower()) for u, k in symbols if k.lower() in RUSSIAN and len(k) == 1]
        if sum(a == b for a, b in judged) < 0.8 * len(judged):
            return "".join(mapping.get(u) or k for u, k in symbols)
    return undo(piece, pages)


_TURN = re.compile(r"[a-zа-яё][A-ZА-ЯЁ]")
_SIGN = re.compile("(?:â€|вЂ).")
#: Letters that a stretch of Russian letters alone must have: fewer may be a name or a slip.
LEAST_LETTERS = 12


def is_case(piece: str, words: list[tuple[str, str]], lang: Language, pages: tuple[str, ...] = ()) -> bool:
    """Whether the reading makes language of the stretch.

    Judged are the words that change (``read_words``): unbroken runs and numbers that stand
    among them are as unlikely before as after.
    """
    if pages and pages[0] == "utf-8" and any(len(p := undo(m.group(), pages)) == 1 and p in SIGNS for m in _SIGN.finditer(piece)):
        return True  # a dash, quotation mark or apostrophe of three bytes
    raw, read = " ".join(w for w, _ in words), " ".join(p for _, p in words)
    score, letters = lang.score(read)
    if letters < 3:
        return False
    if all(ch in RUSSIAN for ch in raw.lower() if ch.isalpha()) and (letters < LEAST_LETTERS or len(words) < 2):
        return False
    turns = len(_TURN.findall(read)) - len(_TURN.findall(raw))
    gain = score - lang.score(raw)[0]
    return gain >= GAIN and gain / letters >= GAIN_PER_LETTER and score / letters > lang.usual - 1.0 and turns <= 0.02 * letters


def _texts(records: DataFrame) -> DataFrame:
    return with_columns(records, "doc_id", "source_code", "text").filter("doc_id is not null and text is not null and text <> ''")


def garbled_pieces(records: DataFrame) -> DataFrame:
    """(doc_id, start, stop, plain, lost): the stretches that are cases, and lost letters.

    ``start`` and ``stop`` count code points of the text as stored; ``plain`` is the stretch
    read rightly.  A row with ``lost`` > 0 stands for letters that stand-in characters replaced,
    which cannot be restored.

    ``records``: ``doc_id, source_code, text``; other columns are ignored.  Null or empty
    texts and null ids have no rows; a null source is a source of its own; repeated rows give
    the same stretch once.  An empty table gives an empty result.
    """
    tune_arrow(records.sparkSession, 500)
    texts = _texts(records)
    counts = _bigram_table(texts.select("text"))
    segments = durable(_segments(texts, counts), "segments")
    mappings = durable(learnt_mappings(segments, counts), "mappings")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang = Language(counts)
        for frame in frames:
            out = []
            for doc, start, stop, piece, mapping, pages in frame.itertuples(index=False):
                mapping, pages = dict(mapping), tuple(pages)
                words = read_words(piece, pages, mapping)
                if words and is_case(piece, words, lang, pages):
                    out.append((doc, start, stop, restored(piece, mapping, pages), 0))
            yield pd.DataFrame(out, columns=["doc_id", "start", "stop", "plain", "lost"])

    # A source's stretches by known chains meet the mapping of their chain, others each free
    # mapping that was confirmed for their source (at most one for each script).
    s, m = segments.filter("lost = 0").alias("s"), mappings.alias("m")
    if mappings.limit(FEW_MAPPINGS + 1).count() <= FEW_MAPPINGS:
        m = F.broadcast(m)
    same = (F.col("s.chain") == F.col("m.chain")) | ((F.col("s.chain") < 0) & (F.col("m.chain") < 0))
    joined = s.join(m, F.col("s.source_code").eqNullSafe(F.col("m.source_code")) & same)
    read_ = joined.select("doc_id", "start", "stop", "piece", "mapping", "pages").mapInPandas(read, "doc_id bigint, start int, stop int, plain string, lost int")
    # Where two free mappings read one stretch, one reading stays.
    read_ = read_.groupBy("doc_id", "start", "stop", "lost").agg(F.min("plain").alias("plain")).select("doc_id", "start", "stop", "plain", "lost")
    gone = segments.filter("lost > 0").select("doc_id", "start", "stop", F.lit(None).cast("string").alias("plain"), "lost")
    return read_.unionByName(gone).distinct()


def garbled_records(records: DataFrame) -> DataFrame:
    """(doc_id): records whose text was read with a wrong encoding, wholly or in part."""
    return garbled_pieces(records).select("doc_id").distinct()


def restored_texts(records: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, lost, confirmed) of the garbled records.

    ``text`` is the text with every garbled stretch replaced, ``lost`` the number of letters
    that cannot be restored, ``confirmed`` whether the SHA-256 of the text is the hash of a
    body served for the record in ``fetches (doc_id, body_sha256)``; null without fetches.
    """
    pieces = garbled_pieces(records).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "plain")).alias("pieces"), F.sum("lost").alias("lost"))
    texts = _texts(records).select("doc_id", "text").join(pieces, "doc_id")

    @F.pandas_udf("string")
    def replace(text: pd.Series, spots: pd.Series) -> pd.Series:
        def one(t: str, found) -> str:
            for p in sorted(found, key=lambda x: -x["start"]):
                if p["plain"] is not None:
                    t = t[: p["start"]] + p["plain"] + t[p["stop"] :]
            return t

        return pd.Series([one(t, f) for t, f in zip(text, spots)], dtype=object)

    out = texts.select("doc_id", replace("text", "pieces").alias("text"), "lost").dropDuplicates(["doc_id"])
    if fetches is None:
        return out.withColumn("confirmed", F.lit(None).cast("boolean"))
    served = with_columns(fetches, "doc_id", "body_sha256").filter("doc_id is not null and body_sha256 is not null").distinct().withColumn("confirmed", F.lit(True))
    hashed = out.withColumn("body_sha256", F.sha2("text", 256))
    return hashed.join(served, ["doc_id", "body_sha256"], "left").select("doc_id", "text", "lost", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
