"""Personal data in text, disguised or not, with offsets in the source.

A chain of small transducers rewrites a text: homoglyphs and invisible signs,
letters used as digits, spelled digits, and at/dot disguises. Each rewritten
character remembers which source characters it came from, so a span found in the
rewritten text maps back to the source. What the plain detectors find in the
source stays; the rewritten text only adds spans that hold a rewritten character
and do not lie inside a plain span of their kind.

Kinds, in this order: email, ip, card, phone. Offsets are code points, the end
exclusive.

Cases: null and empty texts have no spans; repeated documents are judged one by
one; further columns are carried along by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").finditer
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_DIGIT = re.compile("[0-9]").search
_NO_DIGITS = re.compile("[^0-9]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ so that plain words cost nothing."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        rest = _DOMAIN(text, at + 1) if begin < at else None
        if rest:
            found.append((begin, rest.end()))
        free = rest.end() if rest else at + 1
        at = text.find("@", free)
    return found


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    values = [int(d) for d in reversed(digits)]
    doubled = [d * 2 - 9 * (d > 4) for d in values[1::2]]
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD(text) if 16 <= len(d := _NO_DIGITS.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE(text) if 8 <= len(_NO_DIGITS.sub("", m[0])) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    """Leftmost, non-overlapping spans of each kind."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT(text):
        found["ip"], found["card"] = ips(text), cards(text)
        if "+" in text:
            found["phone"] = phones(text)
    return found


# --- transducers -------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυιІЈЅ",
        "ABEKMHOPCTYXaeopcyxijsdhlqwABEZHIKMNOPTYXavoptuiIJS",
        strict=True,
    )
)
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], "")


def _glyphs() -> dict[int, str]:
    """Replacement of each character that stands for one ASCII letter, digit or sign."""
    table = {ord(k): v for k, v in LOOKALIKES.items()} | INVISIBLE
    blocks = [range(0x2460, 0x24EA), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2070, 0x209D)]
    for block in blocks:  # circled, full-width, mathematical, raised and lowered forms
        for code in block:
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                table[code] = plain
    for code in range(0x600, 0x10000):  # decimal digits of other scripts
        if unicodedata.category(chr(code)) == "Nd":
            table.setdefault(code, str(unicodedata.digit(chr(code))))
    table |= {0xFE52: ".", 0x3002: ".", 0xFE6B: "@", 0x2024: ".", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0xA0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " "}
    return table


GLYPHS = _glyphs()

#: Digits as words, by value, in the four languages of the texts.
DIGIT_WORDS = {
    "0": "zero oh null cero zéro",
    "1": "one eins uno",
    "2": "two zwei zwo dos deux",
    "3": "three drei tres trois",
    "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq",
    "6": "six sechs seis",
    "7": "seven sieben siete sept",
    "8": "eight acht ocho huit",
    "9": "nine neun nueve neuf",
}
AT_WORDS = "at arroba ät chez"
DOT_WORDS = "dot punkt punto point"
PLUS_WORDS = "plus más mas"
DASH_WORDS = "dash hyphen minus"

_VALUE = {w: d for d, line in DIGIT_WORDS.items() for w in line.split()}
_VALUE |= dict.fromkeys(DOT_WORDS.split(), ".") | dict.fromkeys(PLUS_WORDS.split(), "+") | dict.fromkeys(DASH_WORDS.split(), "-")


def _either(*lines: str) -> str:
    return "|".join(sorted({w for line in lines for w in line.split()}, key=lambda w: (-len(w), w)))


_DIGIT_WORD = _either(*DIGIT_WORDS.values())
_LINK_WORD = _either(DOT_WORDS, DASH_WORDS)
_GAP = r"[ \t\n,./_-]*"
# A run: a first spelled digit (or a plus before a digit), then digits, spelled digits and words for signs.
_SPELLED = re.compile(rf"\b(?:(?:{_either(PLUS_WORDS)}){_GAP})?(?:{_DIGIT_WORD})\b(?:{_GAP}(?:\b(?:{_DIGIT_WORD}|{_LINK_WORD})\b|\+?[0-9]++))+|(?:\b(?:{_either(PLUS_WORDS)}){_GAP}|\+)?(?<![0-9])[0-9]++(?:[ \t,._-]++[0-9]++)*+{_GAP}\b(?:{_DIGIT_WORD}|{_LINK_WORD})\b(?:{_GAP}(?:\b(?:{_DIGIT_WORD}|{_LINK_WORD})\b|[0-9]++))*", re.I)
_PART = re.compile(rf"(?:{_either(*DIGIT_WORDS.values(), DOT_WORDS, PLUS_WORDS, DASH_WORDS)})|[0-9]|[+.-]", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_AT = re.compile(rf"[ \t]*{_OPEN}[ \t]*(?:{_either(AT_WORDS)}|@)[ \t]*{_CLOSE}[ \t]*", re.I)
_BRACKET_DOT = re.compile(rf"[ \t]*{_OPEN}[ \t]*(?:{_either(DOT_WORDS)}|\.)[ \t]*{_CLOSE}[ \t]*", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_DOTTED = rf"(?:[ \t]+(?:{_either(DOT_WORDS)})[ \t]+|[ \t]*\.[ \t]*)"
# An address in words: the domain ends in a spelled dot and a short label, or the at is spelled before a plain domain.
_WORD_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:[ \t]+(?:{_either(DOT_WORDS)})[ \t]+[A-Za-z0-9_%+-]+)*(?:[ \t]+(?:{_either(AT_WORDS)})[ \t]+|[ \t]*@[ \t]*){_LABEL}(?:{_DOTTED}{_LABEL})*[ \t]+(?:{_either(DOT_WORDS)})[ \t]+[A-Za-z]{{2,8}}\b", re.I)
_KNOWN_ENDINGS = "com org net edu gov info io de fr es uk eu example test invalid"
#: Endings of file names and times of day, which follow an "at" in plain prose.
_NOT_ENDINGS = "am pm html htm php asp aspx jsp js ts css py java cpp cs rb rs sh bat exe dll txt md csv tsv json xml yaml yml sql log ini cfg pdf doc docx xls xlsx ppt pptx rtf jpg jpeg png gif svg bmp mp mpg mpeg avi mov wav zip tar gz rar bak tmp"
# Any other label of 2 to 8 letters is an ending if it is in small letters, or in capitals behind a capital. A capital first letter begins a sentence.
_SMALL_ENDING = rf"(?-i:(?!(?:{_either(_NOT_ENDINGS)})\b)[a-z]{{2,8}})"
_ENDING = rf"(?:{_either(_KNOWN_ENDINGS)}|{_SMALL_ENDING}|(?-i:(?<=[A-Z]\.)[A-Z]{{2,8}}))"
# A bare "at" before such a domain may be plain prose that lacks the blank behind a full stop ("at noon.then"). What else speaks for an
# address: a known ending; two letters that are no common word; a name with a sign or a digit in it; or a word for mail shortly before.
_TWO_LETTER_WORDS = "am an as at be by do go he hi if in is it me my no of oh ok on or so to up us we"
_PLAIN_DOMAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9._%+-]+)[ \t]+(?:{_either(AT_WORDS)})[ \t]+{_LABEL}(?:\.{_LABEL})*\.(?P<ending>{_ENDING})\b(?![\w-])", re.I)
_SIGNED_NAME = re.compile(r"[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*(?:[0-9]|[._%+-][A-Za-z0-9])")
_MAIL_CUE = re.compile(r"\b(?:e-?mails?|mail(?:ed|ing|s|to)?|contact|reach|write|correo|contacto|kontakt|schreib\w*|courriel|contactez)\b", re.I)
#: How many characters before a name are searched for a word for mail.
CUE_REACH = 40


def _is_address(m: re.Match) -> bool:
    """Whether more than a bare "at" speaks for an address."""
    ending = m["ending"].lower()
    if ending in _KNOWN_ENDINGS.split() or (len(ending) == 2 and ending not in _TWO_LETTER_WORDS.split()):
        return True
    return bool(_SIGNED_NAME.match(m["name"]) or _MAIL_CUE.search(m.string, max(0, m.start() - CUE_REACH), m.start()))


_IN_ADDRESS = re.compile(rf"[ \t]+(?:{_either(AT_WORDS)})[ \t]+|[ \t]*@[ \t]*|[ \t]+(?:{_either(DOT_WORDS)})[ \t]+", re.I)
# The same with underscores or hyphens for blanks, with entities for signs, and with blanks around both signs.
_JOINED_ADDRESS = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9.%+]+(?P<gap>[_-])(?:{_either(AT_WORDS)})(?P=gap)[A-Za-z0-9]+(?:(?P=gap)(?:{_either(DOT_WORDS)})(?P=gap)[A-Za-z0-9]+)+", re.I)
_IN_JOINED = re.compile(rf"([_-])({_either(AT_WORDS, DOT_WORDS)})\1", re.I)
_ENTITY_AT = re.compile(r"&(?:#0*64|#x0*40|commat);", re.I)
_ENTITY_DOT = re.compile(r"&(?:#0*46|#x0*2e|period);", re.I)
_SPACED_DOT = re.compile(rf"(?<=@)(?:{_LABEL}[ \t]+\.[ \t]+)+(?=(?:com|org|net|edu|gov|{_SMALL_ENDING}|(?-i:[A-Z]{{2,8}}))\b)", re.I)
_BLANK_DOT = re.compile(r"[ \t]+\.[ \t]+")
_SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:[ \t]+@[ \t]*|@[ \t]+)(?={_LABEL}[ \t]*\.)")
# A bar with a blank before and after is the rule of a table, not a digit.
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OoIl|.-]*[0-9])(?!\| )[0-9OoIl|]+(?:(?: (?!\|(?![0-9OoIl|.-]))|[.-])[0-9OoIl|]+)*(?![A-Za-z0-9])")

Piece = tuple[str, int, int]


class Rewritten:
    """A text with, for each character, the source span it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.begin = range(len(text))
        self.end = range(1, len(text) + 1)
        self.new = bytes(len(text))

    def rewrite(self, pattern: re.Pattern, pieces: Callable[[re.Match], Iterator[Piece]]) -> None:
        """Replace parts of each match: ``pieces`` yields new characters and the part they replace, in order."""
        out, begin, end, new, last = [], [], [], bytearray(), 0
        for m in pattern.finditer(self.text):
            for put, a, b in pieces(m):
                out.append(self.text[last:a])
                begin += self.begin[last:a]
                end += self.end[last:a]
                new += self.new[last:a]
                out.append(put)
                begin += [self.begin[a]] * len(put)
                end += [self.end[b - 1]] * len(put)
                new += b"\1" * len(put)
                last = b
        if last:
            self.text = "".join(out) + self.text[last:]
            self.begin, self.end, self.new = [*begin, *self.begin[last:]], [*end, *self.end[last:]], bytes(new) + self.new[last:]

    def source(self, span: Span) -> Span | None:
        """The source span, or None if nothing in it was rewritten."""
        a, b = span
        begin, end = self.begin[a], self.end[b - 1]
        return (begin, end) if any(self.new[a:b]) or end - begin != b - a else None


def _glyph(m: re.Match) -> Iterator[Piece]:
    yield GLYPHS[ord(m[0])], m.start(), m.end()


def _spelled(m: re.Match) -> Iterator[Piece]:
    """Each word becomes its sign; what separates two digits goes."""
    last = m.start()
    for part in _PART.finditer(m[0]):
        a, b = m.start() + part.start(), m.start() + part.end()
        if a > last:
            yield "", last, a
        word = part[0].lower()
        if word in _VALUE:
            yield _VALUE[word], a, b
        last = b


def _as(sign: str) -> Callable[[re.Match], Iterator[Piece]]:
    def pieces(m: re.Match) -> Iterator[Piece]:
        yield sign, m.start(), m.end()

    return pieces


def _address(m: re.Match) -> Iterator[Piece]:
    for part in _IN_ADDRESS.finditer(m[0]):
        word = part[0].strip().lower()
        yield "." if word in DOT_WORDS.split() else "@", m.start() + part.start(), m.start() + part.end()


def _plain_domain(m: re.Match) -> Iterator[Piece]:
    if _is_address(m):
        yield from _address(m)


def _joined(m: re.Match) -> Iterator[Piece]:
    for part in _IN_JOINED.finditer(m[0]):
        yield "." if part[2].lower() in DOT_WORDS.split() else "@", m.start() + part.start(), m.start() + part.end()


def _blank_dots(m: re.Match) -> Iterator[Piece]:
    for part in _BLANK_DOT.finditer(m[0]):
        yield ".", m.start() + part.start(), m.start() + part.end()


def _letters(m: re.Match) -> Iterator[Piece]:
    letters = sum(c in "OoIl|" for c in m[0])
    if letters and sum(c in "0123456789" for c in m[0]) >= letters:
        for i, c in enumerate(m[0]):
            if c in "OoIl|":
                yield "0" if c in "Oo" else "1", m.start() + i, m.start() + i + 1


def normalised(text: str) -> Rewritten | None:
    """The rewritten text, or None if there was nothing to rewrite."""
    made = Rewritten(text)
    signs = "" if text.isascii() else "".join(c for c in set(text) if ord(c) in GLYPHS)
    if signs:
        made.rewrite(re.compile(f"[{re.escape(signs)}]"), _glyph)
    if "&" in text:
        made.rewrite(_ENTITY_AT, _as("@"))
        made.rewrite(_ENTITY_DOT, _as("."))
    made.rewrite(_BRACKET_AT, _as("@"))
    made.rewrite(_BRACKET_DOT, _as("."))
    lower = made.text.lower()
    if any(w in lower for w in DOT_WORDS.split()):
        made.rewrite(_WORD_ADDRESS, _address)
        made.rewrite(_JOINED_ADDRESS, _joined)
    made.rewrite(_PLAIN_DOMAIN, _plain_domain)
    if "@" in made.text:
        made.rewrite(_SPACED_AT, _as("@"))
        made.rewrite(_SPACED_DOT, _blank_dots)
    if _DIGIT(made.text):
        made.rewrite(_LETTER_DIGITS, _letters)
    made.rewrite(_SPELLED, _spelled)
    return made if made.text != text else None


# --- which texts of a slice can hold anything -----------------------------------------------------


def _word_table(*lines: str) -> np.ndarray:
    """Slots of the hashes of words, in small letters and as they look when written in capitals."""
    table = np.zeros(1 << 16, bool)
    for line in lines:
        for w in line.split():
            for form in (w, w.upper()):
                raw = np.frombuffer(form.encode(), np.uint8)
                table[tx.word_hashes(raw, np.array([0]), np.array([len(raw)])) >> np.uint64(48)] = True
    return table


_SIGN_WORDS = _word_table(*DIGIT_WORDS.values(), DOT_WORDS, PLUS_WORDS, DASH_WORDS)
_AT, _DOT = _word_table(AT_WORDS), _word_table(DOT_WORDS)


def _bytes(which) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(which)] = True
    return table


_DIGIT_BYTES, _OPEN_BYTES, _LIKE_DIGIT = _bytes(range(48, 58)), _bytes(b"[({<"), _bytes(b"OoIl|")
_ENTITY_START = _bytes(b"#cCpP")
_LETTER_OR_DIGIT = _bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LABEL_BYTES, _BETWEEN_GROUPS = _LETTER_OR_DIGIT | _bytes(b"-"), _bytes(b" .-")
_FOREIGN, _SIGN_AFTER_C2 = _bytes(range(0xCA, 0xF8)), _bytes([0xA0, 0xAD, 0xB2, 0xB3, 0xB9])


def _per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a marked byte."""
    at = np.flatnonzero(marks)
    return np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])


def hints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts may hold plain spans and which may hold disguised ones; the others hold none."""
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(n, bool), np.zeros(n, bool)
    after = np.append(data[1:], 0).astype(np.uint8)
    digit, at_sign = _DIGIT_BYTES[data], data == 64
    plain = _per_text(digit | at_sign, offsets)
    like = _LIKE_DIGIT[data]
    marks = _OPEN_BYTES[data] | _FOREIGN[data] | ((data == 0xC2) & _SIGN_AFTER_C2[after])
    marks[:-1] |= (digit[:-1] & like[1:]) | (like[:-1] & digit[1:])
    # Groups of digits and of letters used as digits, with one sign between; a group ends where other letters or digits do not go on.
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    other = _LETTER_OR_DIGIT[data] & ~digit & ~like
    goes_on, went_on = np.append(other[1:], False), np.insert(other[:-1], 0, False)
    goes_on[inner - 1] = went_on[inner] = False
    between = _BETWEEN_GROUPS[data[1:-1]]
    marks[1:-1] |= between & ((digit[:-2] & (like & ~goes_on)[2:]) | ((like & ~went_on)[:-2] & digit[2:]))
    marks |= (data == 38) & _ENTITY_START[after]
    # Dotless and dotted i and long s, which are i and s in any case.
    marks |= ((data == 0xC4) & ((after == 0xB0) | (after == 0xB1))) | ((data == 0xC5) & (after == 0xBF))
    blank = (data == 32) | (data == 9)
    marks[:-1] |= (at_sign[:-1] & blank[1:]) | (blank[:-1] & at_sign[1:])
    disguised = _per_text(marks, offsets)
    spaced_dot = np.zeros(len(data), bool)
    spaced_dot[1:-1] = blank[:-2] & (data[1:-1] == 46) & blank[2:]
    disguised |= _per_text(at_sign, offsets) & _per_text(spaced_dot, offsets)
    # Latin-1 signs end a word as ASCII signs do.
    sign_of_two = (data == 0xC2) | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7)))
    if sign_of_two.any():
        data = data.copy()
        at = np.flatnonzero(sign_of_two)
        data[at] = data[at + 1] = 32
    starts, ends, rows = tx.words(data, offsets, tx.PLAIN)
    if len(starts):
        slot = tx.word_hashes(data, starts, ends) >> np.uint64(48)
        sign, at, dot = _SIGN_WORDS[slot], _AT[slot], _DOT[slot]
        number, numbered = digit[starts], digit[ends - 1]
        same = rows[1:] == rows[:-1]
        pair = same & ((sign[:-1] & (sign | number)[1:]) | (numbered[:-1] & sign[1:]))
        disguised[rows[:-1][pair]] = True
        # A spelled at, blanks, a label, a dot and a label.
        stops = np.append(np.flatnonzero(~_LABEL_BYTES[data]), len(data))
        begins = np.append(np.flatnonzero(~blank), len(data))
        label = begins[np.searchsorted(begins, ends[at])]
        stop = stops[np.searchsorted(stops, label)]
        more = np.append(data, [0, 0]).astype(np.uint8)
        domain = (stop > label) & (more[stop] == 46) & _LABEL_BYTES[more[stop + 1]]
        disguised[rows[at][domain]] = True
        has_at = _per_text(at_sign, offsets)
        has_at[rows[at]] = True
        has_dot = np.zeros(n, bool)
        has_dot[rows[dot]] = True
        disguised |= has_at & has_dot
    return plain, disguised


def spans(column: pa.Array) -> Iterator[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """Plain and added spans of each text of a column; texts without a hint are not even decoded."""
    none: dict[str, list[Span]] = {k: [] for k in KINDS}
    data, offsets = tx.text_buffer(column)
    plain, disguised = hints(data, offsets)
    for i in range(len(column)):
        if not (plain[i] or disguised[i]):
            yield none, none
            continue
        text = column[i].as_py()
        base = detect(text) if plain[i] else none
        yield base, added(text, base) if disguised[i] else none


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of disguised identifiers, in source offsets, that no plain span of their kind contains."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    made = normalised(text)
    if made is None:
        return found
    for kind, spans in detect(made.text).items():
        for span in spans:
            at = made.source(span)
            if at and not any(a <= at[0] and at[1] <= b for a, b in base[kind]):
                found[kind].append(at)
    return found


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and added spans of a text."""
    base = detect(text)
    return base, added(text, base)


def listed(*found: dict[str, list[Span]]) -> str:
    """kind:start:end of all spans, by kind and start."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(s for f in found for s in f[k]))


def covered(text: str, *found: dict[str, list[Span]]) -> str:
    """The text with every span replaced by the name of its kind; spans that overlap become one."""
    out, last = [], 0
    for a, b, k in sorted((a, b, k) for f in found for k in KINDS for a, b in f[k]):
        if a >= last:
            out += [text[last:a], f"[{k.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the plain spans by kind, their digest, all spans, and how many were added."""
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                counts: list[list[int]] = [[] for _ in KINDS]
                digests, all_spans, more = [], [], []
                for base, extra in spans(part.column(1)):
                    for k, c in zip(KINDS, counts):
                        c.append(len(base[k]))
                    digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    all_spans.append(listed(base, extra))
                    more.append(sum(map(len, extra.values())))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(more, pa.int64())], names)

    return picked.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with every span replaced by the name of its kind; all columns kept, a null text stays null."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, text_column):
                i = part.schema.get_field_index(text_column)
                column = part.column(i)
                texts = {j: covered(column[j].as_py(), *found) for j, found in enumerate(spans(column)) if any(map(any, (f.values() for f in found)))}
                if texts:
                    column = pa.array([texts[j] if j in texts else v.as_py() for j, v in enumerate(column)], column.type)
                yield part.set_column(i, part.schema.field(i), column)

    return docs.mapInArrow(run, columns)
