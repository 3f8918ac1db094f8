"""Personal data by fixed patterns and a linear-chain conditional random field (operator 11).

The patterns find the four kinds in their usual form.  The field finds forms that they
miss (national telephone numbers, "name (at) host (dot) com", cards and addresses with
other separators).  It labels tokens, which are runs of letters or digits and single
other signs, by their shapes and those of their neighbours; no letters of a word but
those of two short fixed lists are seen.  It is trained by its likelihood on a small
labelled table: windows around the patterns' matches in a bounded sample of documents,
windows with digits or signs that are no match, and rewritten forms of the matches.
Tokens further than ``REACH`` tokens from any digit, ``@``, or word or sign of an address
have no label; the others are decoded by Viterbi, many stretches at once.

A span of the field counts if it meets none of the patterns' and passes its kind's
check (digits, Luhn's sum, parts).  The patterns' spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Documents that are looked through for labelled windows, and windows that are kept, at most.
SAMPLE, WINDOWS = 4000, 800
#: Characters on each side of a labelled window.
MARGIN = 60
#: Tokens on each side of a telling one that are decoded.
REACH = 6
#: Characters of text that are cut into tokens at once.
SLICE = 1 << 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[.\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the digits' sum, every second from the right doubled, ends in 0."""
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def _small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start.

    The same matches as the patterns', in time that grows with the text: the place
    before an ``@`` is looked for from it, and runs are never tried from their middle.
    """
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", last)
    ips, cards = [], []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() > 6:
            for x in _IP.finditer(text, m.start(), m.end()):
                if all(map(_small, x.group().split("."))):
                    ips.append((1, x.start(), x.end()))
            for x in _CARD.finditer(text, m.start(), m.end()):
                digits = _NOT_DIGIT.sub("", x.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    cards.append((2, x.start(), x.end()))
    out += ips + cards
    if "+" in text:
        for x in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", x.group())) <= 15:
                out.append((3, x.start(), x.end()))
    return out


# Tokens and what is seen of them.

#: Words and signs that stand for @ and for the dot of an address.
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punto", "punkt", "point")
#: Words that stand before a number or end an address.
CALL_WORDS = ("tel", "phone", "call", "fax", "mobile", "telefon", "tlf", "mob", "tfno")
END_WORDS = ("com", "org", "net", "edu", "de", "fr", "es", "uk", "eu")
_LISTED = {w: k for k, words in enumerate((AT_WORDS, DOT_WORDS, CALL_WORDS, END_WORDS), 1) for w in words}
_LONGEST = max(map(len, _LISTED))
_SIGNS = "@.-()[]{}+/:_,;=\"'#%*&$!?<>|~\\"
#: Symbols: 1 to 4 listed words, 5 to 10 letters by length, 11 to 31 digits by length, then signs.
_OTHER = 32 + len(_SIGNS)
N_SYMBOLS = _OTHER + 1
#: Symbols before and after a stretch.
_EDGE = N_SYMBOLS
#: What is seen of a token beside its symbol, from 0 on: (space before, space after, number up to 255, Luhn's sum of its cluster, digits of its cluster in 8 classes).
N_TRAITS = 2 * 2 * 2 * 2 * 8
N_PAIRS = (N_SYMBOLS + 1) ** 2
OFFSETS = range(-4, 5)
N_LABELS = 1 + 2 * len(KINDS)
#: Digits joined by at most two signs make a cluster.
_CLUSTER = re.compile(r"[0-9]++(?:[\x20()./:\[\]-]{1,2}[0-9]++)*+")
_CLASS_ENDS = (7, 9, 11, 13, 16, 20)


def _classes(codes: np.ndarray) -> np.ndarray:
    """0 for white space, 1 for letters, 2 for digits, 3 for ASCII signs."""
    out = np.ones(len(codes), dtype=np.int8)
    ascii_ = codes < 128
    out[ascii_] = _ASCII[codes[ascii_]]
    out[(codes == 0xA0) | (codes == 0x3000) | (codes >= 0x2000) & (codes <= 0x200B)] = 0
    return out


_ASCII = np.array([0 if c <= 32 or c == 127 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)], dtype=np.int8)
_SIGN = np.full(128, _OTHER, dtype=np.int16)
_SIGN[[ord(c) for c in _SIGNS]] = 32 + np.arange(len(_SIGNS))
_LETTERS = np.array([5, 5, 6, 7, 8, 8, 9, 9, 9, 9, 10], dtype=np.int16)


class Tokens:
    """Tokens of a text: where they start and end, their symbols, and which are telling."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _classes(codes)
        new = np.ones(len(kind), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(kind))
        keep = kind[first] > 0
        self.start, self.end = first[keep], last[keep]
        own, size = kind[self.start], self.end - self.start
        self.symbol = np.where(own == 1, _LETTERS[np.minimum(size, 10)], 10 + np.minimum(size, 21)).astype(np.int16)
        sign = own == 3
        self.symbol[sign] = _SIGN[codes[self.start[sign]]]
        # A telling token: a digit run, @, a word that stands for a dot, a dot inside a word, a bracket before a word that stands for @.
        self.listed = {}
        telling = (own == 2) | (self.symbol == 32)
        short = np.flatnonzero((own == 1) & (size <= _LONGEST) & (size > 1))
        for i, a, b in zip(short.tolist(), self.start[short].tolist(), self.end[short].tolist(), strict=True):
            if (word := text[a:b]) in _LISTED or (word := word.lower()) in _LISTED:
                self.symbol[i] = _LISTED[word]
                if self.symbol[i] == 2:
                    telling[i] = True
        glued = np.zeros(len(self.start) + 1, dtype=bool)
        glued[1:-1] = self.start[1:] == self.end[:-1]
        dot = (self.symbol == 33) & glued[:-1] & glued[1:]
        dot[1:-1] &= (own[:-2] == 1) & (own[2:] == 1)
        telling |= dot
        telling[1:] |= (self.symbol[1:] == 1) & np.isin(self.symbol[:-1], _BRACKETS)
        self.glued, self.telling, self.text = glued, telling, text

    def stretches(self) -> list[tuple[int, int]]:
        """(first, end) of the runs of tokens that are within reach of a telling one."""
        at = np.flatnonzero(self.telling)
        if not len(at):
            return []
        first, end = np.maximum(at - REACH, 0), np.minimum(at + REACH + 1, len(self.start))
        cut = np.flatnonzero(first[1:] > end[:-1]) + 1
        return list(zip(first[np.append(0, cut)].tolist(), end[np.append(cut - 1, len(at) - 1)].tolist(), strict=True))

    def traits(self, a: int, b: int) -> np.ndarray:
        """What is seen of the tokens of a stretch beside their symbols."""
        out = (~self.glued[a:b]).astype(np.int64) + 2 * (~self.glued[a + 1 : b + 1])
        begin, stop = int(self.start[a]), int(self.end[b - 1])
        starts = self.start[a:b]
        for m in _CLUSTER.finditer(self.text, begin, stop):
            digits = _NOT_DIGIT.sub("", m.group())
            sort = sum(len(digits) >= x for x in _CLASS_ENDS) + 1
            value = 8 * (16 <= len(digits) <= 19 and luhn(digits)) + 16 * sort
            i, j = np.searchsorted(starts, (m.start(), m.end()))
            out[i:j] += value
        for i in np.flatnonzero((self.symbol[a:b] > 10) & (self.symbol[a:b] < 14)).tolist():
            out[i] += 4 * _small(self.text[self.start[a + i] : self.end[a + i]])
        return out


_BRACKETS = [32 + _SIGNS.index(c) for c in "([{<"]


class Field:
    """A linear-chain conditional random field over the tokens' symbols and traits."""

    def __init__(self):
        self.near = np.zeros((len(OFFSETS), N_SYMBOLS + 1, N_LABELS))
        self.pairs = np.zeros((2, N_PAIRS, N_LABELS))
        self.traits = np.zeros((3, N_TRAITS + 1, N_LABELS))
        self.move = np.zeros((N_LABELS, N_LABELS))
        # O is 0, B of kind k is 1 + 2 k, I is 2 + 2 k; I follows B or I of its kind alone.
        self.barred = np.zeros((N_LABELS, N_LABELS), dtype=bool)
        for to in range(2, N_LABELS, 2):
            self.barred[:, to] = True
            self.barred[[to - 1, to], to] = False
        self.begin = np.zeros(N_LABELS)
        self.begin[2::2] = -1e9

    def parameters(self) -> list[np.ndarray]:
        return [self.near, self.pairs, self.traits, self.move]

    @staticmethod
    def seen(symbols: np.ndarray, traits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Numbers of the features of padded stretches (rows x tokens); the padding has the symbol of an edge."""
        wide = np.pad(symbols, ((0, 0), (4, 4)), constant_values=_EDGE)
        n = symbols.shape[1]
        near = [wide[:, 4 + d : 4 + d + n] for d in OFFSETS]
        pairs = [near[3] * (N_SYMBOLS + 1) + near[4], near[4] * (N_SYMBOLS + 1) + near[5]]
        aside = np.pad(traits, ((0, 0), (1, 1)), constant_values=N_TRAITS)
        return near, pairs, [aside[:, k : k + n] for k in range(3)]

    def emissions(self, seen: tuple[np.ndarray, ...]) -> np.ndarray:
        near, pairs, traits = seen
        out = self.near[0][near[0]]
        for table_, of in ((self.near, near), (self.pairs, pairs), (self.traits, traits)):
            for k, x in enumerate(of):
                if table_ is not self.near or k:
                    out += table_[k][x]
        return out

    def decode(self, symbols: np.ndarray, traits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best labels of padded stretches, by Viterbi over all rows at once."""
        e = self.emissions(self.seen(symbols, traits))
        move = np.where(self.barred, -1e9, self.move)
        rows, n = symbols.shape
        back = np.zeros((rows, n, N_LABELS), dtype=np.int8)
        best = self.begin + e[:, 0]
        ends = best.copy()
        for t in range(1, n):
            way = best[:, :, None] + move
            back[:, t] = way.argmax(axis=1)
            best = way.max(axis=1) + e[:, t]
            ends = np.where((sizes > t)[:, None], best, ends)
        out = np.zeros((rows, n), dtype=np.int8)
        label, at = ends.argmax(axis=1), np.arange(rows)
        for t in range(n - 1, -1, -1):
            out[:, t] = np.where(sizes > t, label, 0)
            if t:
                label = np.where(sizes > t, back[at, t, label], label)
        return out

    def fit(self, symbols: np.ndarray, traits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 60, rate: float = 0.15, ridge: float = 2e-4) -> None:
        """Raises the likelihood of labelled stretches, less a ridge penalty, by Adam's steps over all of them."""
        seen = self.seen(symbols, traits)
        rows, n = symbols.shape
        real = np.arange(n)[None, :] < sizes[:, None]
        true = np.zeros((rows, n, N_LABELS))
        true[np.arange(rows)[:, None], np.arange(n)[None, :], labels] = 1
        moved = np.zeros((N_LABELS, N_LABELS))
        both = real[:, 1:]
        np.add.at(moved, (labels[:, :-1][both], labels[:, 1:][both]), 1)
        mean, square = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, rounds + 1):
            p, q = self._marginals(self.emissions(seen), real)
            off = np.where(real[:, :, None], true - p, 0).reshape(-1, N_LABELS)
            slopes = []
            for table_, of in zip((self.near, self.pairs, self.traits), seen, strict=True):
                g = np.empty_like(table_)
                for k, x in enumerate(of):
                    for label in range(N_LABELS):
                        g[k, :, label] = np.bincount(x.ravel(), off[:, label], minlength=table_.shape[1])
                slopes.append(g)
            slopes.append(np.where(self.barred, 0, moved - q))
            for w, g, m, v in zip(self.parameters(), slopes, mean, square, strict=True):
                g = g / rows - ridge * w
                m *= 0.8
                m += 0.2 * g
                v *= 0.95
                v += 0.05 * g * g
                w += rate * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-6)

    def _marginals(self, e: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's label probabilities, and the expected moves over all rows, by forward and backward sums scaled at each token."""
        move = np.exp(np.where(self.barred, -np.inf, self.move))
        rows, n, _ = e.shape
        e = np.exp(e - e.max(axis=2, keepdims=True))
        forward, backward = np.empty_like(e), np.ones_like(e)
        f = np.exp(self.begin) * e[:, 0]
        forward[:, 0] = f / f.sum(axis=1, keepdims=True)
        for t in range(1, n):
            f = forward[:, t - 1] @ move * e[:, t]
            f /= f.sum(axis=1, keepdims=True)
            forward[:, t] = np.where(real[:, t, None], f, forward[:, t - 1])
        q = np.zeros_like(move)
        for t in range(n - 1, 0, -1):
            ahead = e[:, t] * backward[:, t]
            on = real[:, t, None]
            norm = ((forward[:, t - 1] @ move) * ahead).sum(axis=1, keepdims=True)
            q += move * (forward[:, t - 1].T @ np.where(on, ahead / norm, 0))
            b = ahead @ move.T
            backward[:, t - 1] = np.where(on, b / b.sum(axis=1, keepdims=True), 1)
        p = forward * backward
        return p / p.sum(axis=2, keepdims=True), q


def _padded(of: list[tuple[Tokens, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([b - a for _, a, b in of])
    symbols = np.full((len(of), sizes.max()), _EDGE, dtype=np.int64)
    traits = np.full(symbols.shape, N_TRAITS, dtype=np.int64)
    for i, (tokens, a, b) in enumerate(of):
        symbols[i, : b - a] = tokens.symbol[a:b]
        traits[i, : b - a] = tokens.traits(a, b)
    return symbols, traits, sizes


# The labelled table.


def _rewritten(kind: int, span: str, seed: int) -> str:
    """A form of a match that its pattern misses."""
    pick = lambda *of: of[seed % len(of)]
    if kind == 0:
        local, _, host = span.rpartition("@")
        at, dot = pick((" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", " . "), (" AT ", " DOT "), ("(at)", "."))
        return local.replace(".", dot) * (seed % 3 == 0) + local.replace(".", "") * (seed % 3 > 0) + at + host.replace(".", dot)
    digits = _NOT_DIGIT.sub("", span)
    if kind == 1:
        return pick("[.]", " . ", "(.)", "[.]").join(span.split("."))
    if kind == 2:
        sep = pick(".", "/", "  ", " - ", "_")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:].rjust(10, "5")
    return pick(f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}", f"00{digits[:2]} {own[:3]} {own[3:6]} {own[6:]}", f"{own[:3]} {own[3:6]} {own[6:]}", f"0{own[:4]}/{own[4:]}", f"({own[:3]}){own[3:6]}-{own[6:]}")


#: Fixed values of this file: sentences that hold a match of each kind, and such that hold none, for corpora that have few.
_CARRIERS = ("please write to {} before noon", "{} is what we have, and no more", "the list says {}, as before", "old entry: {}\nnew entry follows")
_EXAMPLES = ("ann.lee@mail.example.org", "10.24.133.7", "4111 1111 1111 1111", "+44 20 7946 0123", "info@shop.example", "192.168.0.14", "5500005555555559", "+1 (202) 555-0147")
_NOTHING = (
    "version 4.0 of the licence, see page 17", "on 2024-05-12 at 10:45 we met 3 times", "chapter 12.3.4 ends here", "a sum of 1,250,000.00 in all", "id 48213377 and code 99-1204-7", "order 2023/11/0042",
    "from 1990-1995 and 2001 to 2010", "token = \"9b0b3c6a43eb78aa99cb\"", "number 1234567890123456 is no card", "the end.Next begins", "we met at noon. dot by dot it grew", "look at example.txt and main.py",
    "300.400.500.600 is no place", "12.5 13.75 16.0 7.15 and 4.2", "6083 8645 775 1985 4120", "score 21-19 21-17 15-12", "3.14159265358979", "at 7 (seven) or 8 (eight)", "room 101 - 102 - 103", "5 of 20 (25 %) and 15 of 20 (75 %)",
)


def _seed_rows() -> list[tuple[str, list[tuple[int, int, int]]]]:
    rows = [(text, []) for text in _NOTHING]
    for k, example in enumerate(_EXAMPLES):
        for c, carrier in enumerate(_CARRIERS):
            for seed in range(-1, 7):
                own = example if seed < 0 else _rewritten(k % 4, example, seed)
                at = carrier.index("{}")
                rows.append((carrier.format(own), [(k % 4, at, at + len(own))]))
    return rows


def labelled(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> DataFrame:
    """(text, kind, start, end): windows of at most ``sample`` documents (those of the smallest hash of doc_id), at most ``windows`` of them.

    One around each match of a pattern, with its rewritten form beside it, and one around
    digits and signs where nothing matches (kind is null).  Windows are few, short and bounded.
    """
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()

    def make():
        def each(batch):
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                for kind, a, b in spans:
                    if sum(x < b + MARGIN and y > a - MARGIN for _, x, y in spans) > 1 or b - a > 80:
                        continue
                    before, own, after = text[max(0, a - MARGIN) : a], text[a:b], text[b : b + MARGIN]
                    out.append((before + own + after, kind, len(before), len(before) + len(own)))
                    other = _rewritten(kind, own, zlib.crc32(own.encode("utf-8", "replace")))
                    out.append((before + other + after, kind, len(before), len(before) + len(other)))
                held = 0
                for m in _OTHERS.finditer(text):
                    a, b = m.start() - MARGIN, m.end() + MARGIN
                    if held < 4 and not any(x < b + MARGIN and y > a - MARGIN for _, x, y in spans):
                        out.append((text[max(0, a) : b], None, None, None))
                        held += 1
            return list(zip(*out, strict=True)) if out else None

        return each

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")
    rows = map_batches(picked, make, "text string, kind int, start int, end int")
    # As many of each kind as there is room for, by hash.
    return rows.distinct().orderBy(F.xxhash64("text"), "text", "kind").limit(windows)


_OTHERS = re.compile(r"[0-9]{1,40}|\b(?:at|dot|punto|point|punkt)\b|[a-z]\.[a-z]")


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> Field:
    """A field trained on the labelled windows of docs(doc_id, text) and a few fixed sentences."""
    rows = _seed_rows() + [(r["text"], [] if r["kind"] is None else [(r["kind"], r["start"], r["end"])]) for r in labelled(docs, sample, windows).collect()]
    stretches, labels = [], []
    for text, spans in rows:
        tokens = Tokens(text)
        own = np.zeros(len(tokens.start), dtype=np.int8)
        for kind, a, b in spans:
            i, j = np.searchsorted(tokens.start, a), np.searchsorted(tokens.end, b, side="right")
            own[i:j] = 2 + 2 * kind
            own[i : i + 1] = 1 + 2 * kind
        for a, b in tokens.stretches():
            stretches.append((tokens, a, b))
            labels.append(own[a:b])
    symbols, traits, sizes = _padded(stretches)
    wanted = np.zeros(symbols.shape, dtype=np.int64)
    for i, x in enumerate(labels):
        wanted[i, : len(x)] = x
    field = Field()
    field.fit(symbols, traits, sizes, wanted)
    return field


# Spans of texts.


def _passes(kind: int, span: str) -> bool:
    """The check of a span that the field found."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        words = re.findall(r"[^\W_]+", span.lower())
        has_at, has_dot = "@" in span or any(w in AT_WORDS for w in words[1:-1]), "." in span or any(w in DOT_WORDS for w in words[1:-1])
        return has_at and has_dot and len(words) >= 3 and "\n" not in span
    if re.search(r"[^\W\d_]|\n", span) or not re.match(r"[0-9(+]", span):
        return False
    groups, between = re.findall(r"[0-9]+", span), re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", span)
    if kind == 1:
        return len(groups) == 4 and len(set(between)) == 1 and all(map(_small, groups))
    if kind == 2:
        return 16 <= len(digits) <= 19 and len(set(between)) <= 1 and luhn(digits)
    return 9 <= len(digits) <= 15 and (span[0] in "+(0" or [len(g) for g in groups] == [3, 3, 4])


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(start, piece): a long text cut where plain words stand on both sides, further than a stretch reaches."""
    at = 0
    while len(text) - at > SLICE:
        for m in _PLAIN.finditer(text, at + SLICE):
            middle = text.index(" ", (m.start() + m.end()) // 2)
            if not any(w in _LISTED for w in m.group().lower().split()):
                yield at, text[at:middle]
                at = middle
                break
        else:
            break
    yield at, text[at:]


_PLAIN = re.compile(r"(?:[^\W\d_]{1,40} ){24}")


def _added(field: Field, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The field's spans in each text that pass their check and meet none of ``base``."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[Tokens, int, int]] = []
    where: list[tuple[int, int]] = []

    def decode() -> None:
        order = sorted(range(len(waiting)), key=lambda i: waiting[i][2] - waiting[i][1])
        for k in range(0, len(order), 512):
            own = order[k : k + 512]
            symbols, traits, sizes = _padded([waiting[i] for i in own])
            for i, labels in zip(own, field.decode(symbols, traits, sizes), strict=True):
                tokens, a, _ = waiting[i]
                text, shift = where[i]
                for b in np.flatnonzero(labels % 2 == 1).tolist():
                    e = b + 1
                    while e < len(labels) and labels[e] == labels[b] + 1:
                        e += 1
                    out[text].append((int(labels[b]) // 2, shift + int(tokens.start[a + b]), shift + int(tokens.end[a + e - 1])))
        waiting.clear()
        where.clear()

    held = 0
    for i, text in enumerate(texts):
        for shift, piece in _pieces(text):
            tokens = Tokens(piece)
            for a, b in tokens.stretches():
                for c in range(a, b, 2000):  # no stretch is longer: their cost is that of the longest
                    waiting.append((tokens, c, min(c + 2000, b)))
                    where.append((i, shift))
            held += len(piece)
            if held >= SLICE and waiting:
                decode()
                held = 0
    if waiting:
        decode()
    for i, (found, own) in enumerate(zip(out, base, strict=True)):
        out[i] = sorted(s for s in found if not any(x < s[2] and y > s[1] for _, x, y in own) and _passes(s[0], texts[i][s[1] : s[2]]))
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def spans_of(docs: DataFrame, field: Field) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    The counts and the digest are of the patterns' spans; ``spans`` has the field's as well.
    Null and empty texts have none, repeated rows each give a row, and ids may be null or
    equal.  Other columns are not read.  Places are code points, the end exclusive.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        own = held.value

        def each(batch):
            ids, n, base, spans, added = batch.column("doc_id"), [[] for _ in KINDS], [], [], []
            texts = batch.column("text")
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < SLICE:
                    part.append(texts[at].as_py() or "")
                    size += len(part[-1])
                    at += 1
                found = [base_spans(t) for t in part]
                more = _added(own, part, found)
                for b, m in zip(found, more, strict=True):
                    for k in range(len(KINDS)):
                        n[k].append(sum(s[0] == k for s in b))
                    base.append(hashlib.sha256(_named(b).encode()).hexdigest())
                    spans.append(_named(sorted(b + m)))
                    added.append(len(m))
            return [ids, *n, base, spans, added]

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans_of(docs, fit(docs))
