"""Personal data in texts, also where it is disguised, with places in the original text.

A text goes through a chain of transducers.  Each rewrites what it knows and
remembers for every character it puts out which source characters it stands
for: look-alike and width variants become ASCII and invisible characters go,
spelled digits become digits, and written-out ``at`` and ``dot`` become signs.
Identifiers are then found in the plain text and in the rewritten one; a find
in the latter is mapped back to the source and counts only if something in it
was rewritten, so that plain texts give what the plain patterns give.

Every pattern runs in time linear in the text.  Each row is judged by itself,
whole, where it lies: no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _sliced

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone")

# ---- plain patterns

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does, as a later place in the run leads to the same next character
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            out.append((start, host.end()))
            last = host.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def addresses(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        a, b = m.span()
        if b - a >= 12 and 12 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append((a, b))
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15] if "+" in text else []


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}

# ---- transducers


class Aligned:
    """A rewritten text; character i stands for source characters ``start[i]`` to ``stop[i]``."""

    def __init__(self, text: str, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> None:
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.stop = np.arange(1, len(text) + 1) if stop is None else stop

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """With ``[a, b)`` replaced by a text for each ``(a, b, text)``, in order; each new character stands for all of the replaced ones."""
        if not edits:
            return self
        texts, starts, stops, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            first = self.start[a] if a < len(self.start) else (self.stop[-1] if len(self.stop) else 0)
            last = self.stop[b - 1] if b > a else first
            starts += [self.start[at:a], np.full(len(new), first)]
            stops += [self.stop[at:a], np.full(len(new), last)]
            at = b
        return Aligned("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.start[at:]]), np.concatenate([*stops, self.stop[at:]]))

    def source(self, span: Span) -> Span:
        return int(self.start[span[0]]), int(self.stop[span[1] - 1])


# Letters of other scripts that look like a Latin one.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "i",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".",
}
#: Characters that are not seen.
UNSEEN = "\xad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"


def character_table() -> dict[str, str]:
    """ASCII for each character that has one: digits of all scripts, compatibility forms of letters, digits and signs, spaces, and look-alikes."""
    table = dict.fromkeys(UNSEEN, "") | LOOKALIKES
    for point in (*range(0x80, 0xD800), *range(0xF900, 0x110000)):
        c = chr(point)
        if c in table or unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>")):
            continue
        plain = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
        elif len(plain) == 1 and " " <= plain <= "~":
            table[c] = plain
        elif unicodedata.category(c) == "Zs":
            table[c] = " "
    return table


_TABLE = character_table()
_OTHER = re.compile("[" + "".join(map(re.escape, sorted(_TABLE))) + "]")
_DIGIT_RUN = re.compile(r"[0-9]+")
# letters written for digits inside a number
_AS_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}


def plain_characters(a: Aligned) -> Aligned:
    """Look-alikes, variants and unseen characters; ``O``, ``I`` and ``l`` among digits."""
    if not a.text.isascii() and not _TABLE.keys().isdisjoint(set(a.text)):
        a = a.rewritten([(m.start(), m.end(), _TABLE[m[0]]) for m in _OTHER.finditer(a.text)])
    text, edits, last = a.text, [], 0
    for m in _DIGIT_RUN.finditer(text):
        start, stop = m.span()
        if start < last or not (text[start - 1 : start] in _AS_DIGITS or text[stop : stop + 1] in _AS_DIGITS):
            continue
        while start > last and text[start - 1] in _AS_DIGITS:
            start -= 1
        while stop < len(text) and (text[stop] in _AS_DIGITS or "0" <= text[stop] <= "9"):
            stop += 1
        last = stop
        letters = [k for k in range(start, stop) if text[k] in _AS_DIGITS]
        if 2 * len(letters) <= stop - start and not text[max(start - 1, 0) : start].isalnum() and not text[stop : stop + 1].isalnum():
            edits += [(k, k + 1, _AS_DIGITS[text[k]]) for k in letters]
    return a.rewritten(edits)


# The digits' names, from zero, in English, German, French and Spanish.
NAMES = ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
_DIGITS = {name: str(k) for names in NAMES for k, name in enumerate(names.split())} | {"oh": "0", "fuenf": "5"}
_TIMES = {"double": 2, "triple": 3}
_NAME = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_COUNTED = rf"(?:(?:double|triple)[ \t-]{{1,3}})?{_NAME}"
_GAP = r"(?:[ \t]{1,3}|[ \t]?[,;][ \t]{0,2}|[ \t]?-[ \t]?)"
# at least two names, or one beside a digit
_SPELLED = re.compile(rf"(?<![\w])(?:{_COUNTED}(?:{_GAP}{_COUNTED})+|(?<=[0-9][ -]){_COUNTED}|{_COUNTED}(?=[ -]?[0-9]))(?![\w])", re.I)
_WORD = re.compile(rf"(?:(double|triple)[ \t-]{{1,3}})?({_NAME})(?![\w])", re.I)
_LONE = re.compile(rf"(?<=[0-9])(?:[ \t]+(?:dot|point|punto|punkt)[ \t]+)({_NAME})(?![\w])|(?<![\w])({_NAME})(?=[ \t]+(?:dot|point|punto|punkt)[ \t]+(?:[0-9]|{_NAME}(?![\w])))", re.I)
_HAS_NAME = re.compile(rf"(?<![\w]){_NAME}(?![\w])", re.I)
_PLUS = re.compile(r"(?<![\w])(?:plus|más|mas)[ \t]+(?=[0-9(])", re.I)


def spelled_digits(a: Aligned) -> Aligned:
    """``four one double seven`` as ``4177``, and ``plus`` before digits as the sign."""
    if not _HAS_NAME.search(a.text):
        return _plus(a)
    edits = [(m.start(), m.end(), "".join(_DIGITS[w[2].lower()] * _TIMES.get((w[1] or "").lower(), 1) for w in _WORD.finditer(m[0]))) for m in _SPELLED.finditer(a.text)]
    a = a.rewritten(edits)
    for _ in range(4):  # single digits of an address, from both sides of each dot
        edits = [(m.start(k), m.end(k), _DIGITS[m[k].lower()]) for m in _LONE.finditer(a.text) for k in (1, 2) if m[k]]
        if not edits:
            break
        a = a.rewritten(edits)
    return _plus(a)


def _plus(a: Aligned) -> Aligned:
    return a.rewritten([(m.start(), m.end(), "+") for m in _PLUS.finditer(a.text)])


_AT, _DOT = r"(?:at|arroba|arobase|ät|@)", r"(?:dot|point|punto|punkt|\.)"
_BRACKETED = re.compile(rf"[\[({{<][ \t]{{0,3}}(?:({_AT})|({_DOT}))[ \t]{{0,3}}[\])}}>]", re.I)
_BARE_AT = re.compile(r"(?<=[ \t_])(?:at|arroba|arobase|ät)(?=[ \t_])|(?<=[A-Za-z0-9]-)(?:at|arroba)(?=-[A-Za-z0-9])", re.I)
_DOTTED = re.compile(r"[ \t]{1,3}(?:dot|point|punto|punkt)[ \t]{1,3}|_(?:dot|punto|punkt|point)_|-(?:dot|punto|punkt|point)-|\.", re.I)
_SPACED_DOT = re.compile(r"[ \t]{1,2}\.[ \t]{1,2}|[ \t]{1,2}\.|\.[ \t]{1,2}")
_LABEL = re.compile(r"[A-Za-z0-9]+(?:-(?!(?:dot|punto|punkt|point)-)[A-Za-z0-9]+)*")
_WORDED = re.compile(r"(?<![A-Za-z])(?:dot|point|punto|punkt)(?![A-Za-z])", re.I)
_BETWEEN_DIGITS = re.compile(r"(?<=[0-9])[ \t]{1,3}(?:dot|point|punto|punkt)[ \t]{1,3}(?=[0-9])", re.I)
_SIGN = re.compile(r"(?<=[A-Za-z0-9])[ \t]{0,2}@[ \t]{0,2}(?=[A-Za-z0-9])")
#: Endings of hosts that a written-out address may have; bracketed signs need none.
ENDINGS = frozenset("com org net edu gov mil int info biz io co me app dev ai us uk de fr es it nl be at ch eu ca au nz jp cn in br mx ru pl se no dk fi pt ie example test invalid local".split())


def _spaced(text: str, a: int, b: int, last: int) -> Span:
    """``[a, b)`` with the blanks around it, not before ``last``."""
    while a > last and text[a - 1] in " \t":
        a -= 1
    while b < len(text) and text[b] in " \t":
        b += 1
    return a, b


def written_signs(a: Aligned) -> Aligned:
    """``(at)`` and ``[dot]``, and whole addresses with ``at`` and ``dot`` as words."""
    text = a.text
    edits, last = [], 0
    for m in _BRACKETED.finditer(text):
        if m.start() >= last:
            x, y = _spaced(text, *m.span(), last)
            edits.append((x, y, "@" if m[1] else "."))
            last = y
    a = a.rewritten(edits)
    marked = bool(edits)
    a = a.rewritten([(m.start(), m.end(), ".") for m in _BETWEEN_DIGITS.finditer(a.text)])
    text = a.text
    signs = [m.span() for m in _SIGN.finditer(text)] if "@" in text else []
    if marked or _WORDED.search(text):
        signs += [m.span() for m in _BARE_AT.finditer(text)]
    edits, last = [], 0
    for start, stop in sorted(signs):
        if start < last:
            continue
        plain = "@" in text[start:stop]
        x, y = (start, stop) if plain else _joined(text, start, stop, last)
        if x < max(last, 1) or text[x - 1] not in _LOCAL_CHARS:
            continue
        host = _host(a, y, plain, plain and stop - start > 1)
        if host:
            edits += [*_before(text, x, last), (x, y, "@"), *host]
            last = host[-1][1] + 1
    return a.rewritten(edits)


def _host(a: Aligned, at: int, plain: bool, words: bool) -> list[tuple[int, int, str]]:
    """The dots of a host that begins at ``at`` and has a known ending, if one of its dots, or its sign, is disguised; else none."""
    text, dots, good = a.text, [], 0
    label = _LABEL.match(text, at)
    while label:
        dot = _DOTTED.match(text, label.end()) or (_SPACED_DOT.match(text, label.end()) if plain else None)
        label = _LABEL.match(text, dot.end()) if dot else None
        if label:
            words |= dot[0] != "." or bool(a.stop[dot.start()] - a.start[dot.start()] > 1)
            dots.append((*dot.span(), "."))
            if words and label[0].lower() in ENDINGS:
                good = len(dots)
    return dots[:good]


def _joined(text: str, a: int, b: int, last: int) -> Span:
    """A bare sign with what joins it to its neighbours."""
    if a and text[a - 1] in "_-" and b < len(text) and text[b] == text[a - 1]:
        return a - 1, b + 1
    return _spaced(text, a, b, last)


_BEFORE = re.compile(r"[ \t]{1,3}(?:dot|point|punto|punkt)[ \t]{1,3}\Z", re.I)
_NAMED = re.compile(r"[A-Za-z0-9_%+.-]{1,64}\Z")


def _before(text: str, x: int, last: int) -> list[tuple[int, int, str]]:
    """Dots as words in the name that ends at ``x``."""
    out = []
    for _ in range(4):
        name = _NAMED.search(text, max(last, x - 64), x)
        dot = name and _BEFORE.search(text, max(last, name.start() - 12), name.start())
        if not dot or dot.start() <= last or text[dot.start() - 1] not in _LOCAL_CHARS:
            break
        out.append((*dot.span(), "."))
        x = dot.start()
    return out[::-1]


TRANSDUCERS: tuple[Callable[[Aligned], Aligned], ...] = (plain_characters, spelled_digits, written_signs)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` by the plain patterns."""
    return [(a, kind, b) for kind in KINDS for a, b in FINDERS[kind](text)]


def added_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """What the transducers uncover: finds in which something was rewritten, and that no plain find of their kind holds."""
    aligned = Aligned(text)
    for transducer in TRANSDUCERS:
        aligned = transducer(aligned)
    if aligned.text == text:
        return []
    out = []
    for kind in KINDS:
        held = [(a, b) for a, k, b in base if k == kind]
        at = 0
        for span in FINDERS[kind](aligned.text):
            a, b = aligned.source(span)
            if aligned.text[span[0] : span[1]] == text[a:b]:
                continue
            while at < len(held) and held[at][1] <= a:
                at += 1
            if not (at < len(held) and held[at][0] <= a and b <= held[at][1]):
                out.append((a, kind, b))
    return out


def _order(span: tuple[int, str, int]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


_SPAN = "struct<kind: string, start: long, end: long, base: boolean>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` of each row: kind, code points from start to before end, and whether the plain pattern finds it.

    Spans are in order of their start, then of their kind.  Plain finds of a
    kind do not overlap; uncovered ones may overlap with them where they reach
    further.  A null or empty text has none.  Rows that repeat, and null ids,
    keep a row each; texts of any length are read whole; other columns are
    ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for whole in batches:
            for batch in _sliced(whole, 1):
                found = []
                for text in batch.column(1).to_pylist():
                    base = base_spans(text) if text else []
                    spans = [(*s, True) for s in base] + [(*s, False) for s in (added_spans(text, base) if text else [])]
                    found.append([{"kind": k, "start": a, "end": b, "base": plain} for a, k, b, plain in sorted(spans, key=_order)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<{_SPAN}>")


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "*") -> DataFrame:
    """``docs`` with every character of a span replaced by ``mark``; rows without an id or text pass unchanged, other columns too.

    Rows are rewritten where they lie, each by its own text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.schema.get_field_index(text_col)
            for batch in _sliced(whole, place):
                out = []
                for text in batch.column(place).to_pylist():
                    if text:
                        base = base_spans(text)
                        parts, at = [], 0
                        for a, _, b in sorted([*base, *added_spans(text, base)], key=_order):
                            if b > at:
                                parts += [text[at : max(a, at)], mark * (b - max(a, at))]
                                at = b
                        text = "".join([*parts, text[at:]]) if parts else text
                    out.append(text)
                yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
