"""Personal data: emails, IP addresses, cards and phone numbers, also when they are disguised.

Plain identifiers are matched on the text as it is. Then transducers rewrite it: look-alike characters to
ASCII, spelled digits to digits, "(at)" and "dot" to signs. Each keeps, for every character that it emits,
the source characters that it stands for, so what is detected in the rewritten text maps back exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does, and runs are taken whole, so no start is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Look-alikes of letters, digits and signs, one character each; invisible ones vanish.
LOOKALIKES = (
    dict(zip("аеорсухіјѕһԁӏвкмнтАВЕКМНОРСТХαοερτυκνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdlbkmhtABEKMHOPCTXaoeptukvABEZHIKMNOPTYX", strict=True))
    | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    | {chr(c + k): chr(48 + k) for c in (0x660, 0x6F0, 0x966) for k in range(10)}
    | {"﹫": "@", "。": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "\xa0": " ", " ": " ", " ": " "}
)
INVISIBLE = "​‌‍⁠﻿\xad"
#: Digits in English, German, French and Spanish.
SPELLED = {
    w: str(n)
    for line in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for n, w in enumerate(line.split())
} | {"oh": "0"}
#: Ends of domains that are no words, so that "at host dot end" is an address whatever is before it.
DOMAIN_ENDS = frozenset("com net org edu gov int mil info biz io ai app dev co uk us ca au de at ch fr be nl es it pt eu ru pl se no dk fi jp cn in br mx".split())
#: Words before "at" that are prose and no names, and words before a name that make it prose ("the shop at host.com").
PROSE = frozenset("""look looks looked looking see seen meet meets met meeting available found find live lives lived living work works worked working stay
    stays stayed arrive arrives arrived start starts started begin begins began end ends ended buy registered hosted located based
    published posted listed read visit us me you him her it them we i he she they is are was were be been am not now here there again online everyone all
    and or but that this these those what who where when while more most less best only just even still home price
    prices open closed held stop stopped sit sits sat sitting stand stands stood eat ate call called noon night midnight aimed laugh laughed shout""".split())
BEFORE_PROSE = frozenset("a an the our my your his its their this that these those some any every each new is are was were be been being".split())

_LOOKALIKE = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "]")
_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_DOT_WORD = "(?:dot|point|punkt|punto)"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\x20-]+)?{_DIGIT}(?:(?:[\x20,-]{{1,3}}|\x20{_DOT_WORD}\x20){_DIGIT}){{2,}}(?!\w)", re.I)
_SPELLED_WORD = re.compile(rf"plus|{_DOT_WORD}|{_DIGIT}", re.I)
_SPELLED_SIGN = {"plus": "+"} | dict.fromkeys(("dot", "point", "punkt", "punto"), ".")
_OPEN, _CLOSE = r"[\[({<]\x20?", r"\x20?[\])}>]"
_BRACKETED = re.compile(rf"\x20{{0,2}}{_OPEN}(?:(at|@)|(dot|punkt|point|punto|\.)){_CLOSE}\x20{{0,2}}", re.I)
# A name starts where no dot, written or spelled, is before it, so a chain of parts has one start however long it is.
_NAMED = re.compile(r"(?<![\w.%+-])(?<!\w\x20dot\x20)[A-Za-z0-9_%+-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9_%+-]++)*+(\x20at\x20|@)[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)++", re.I)
#: Ends of domains after which "name @ host . end" is an address and no sentence.
SURE_ENDS = "com net org edu gov mil info biz io co uk ca ru pl se dk jp cn nz fr eu".split()
_LABEL = "[A-Za-z0-9-]{1,63}"  # as long as a part of a host may be
_PART = "(?:(?!(?P=mark)dot(?P=mark))[A-Za-z0-9-]){1,63}+"
# Addresses that are told by both of their signs: "name -at- host -dot- end", "name_at_host_dot_end", "name arroba host punto end", "name @ host . end".
_SIGNED = (
    re.compile(rf"(?<=[A-Za-z0-9])(?P<at>\x20?(?P<mark>[-_*~])at(?P=mark)\x20?)(?P<host>{_PART}(?:\x20?(?P=mark)dot(?P=mark)\x20?{_PART})++)", re.I),
    re.compile(rf"(?<=[A-Za-z0-9])(?P<at>\x20(?:arroba|arobase|klammeraffe)\x20)(?P<host>{_LABEL}(?:(?:\x20{_DOT_WORD}\x20|\.){_LABEL})+)", re.I),
    re.compile(rf"(?<=[A-Za-z0-9])(?P<at>\x20?@\x20?)(?P<host>{_LABEL}(?:\x20?\.\x20?{_LABEL})*?\x20?\.\x20?(?:{'|'.join(SURE_ENDS)}))(?![A-Za-z0-9-])", re.I),
)
_SIGNED_DOT = re.compile(rf"\x20?([-_*~])dot\1\x20?|\x20{_DOT_WORD}\x20|\x20?\.\x20?", re.I)
_DOMAIN_END = re.compile(r"[a-z]{2,24}|xn--[a-z0-9-]+", re.I)
_NEW_SENTENCE = re.compile(r"[a-z0-9-]+\.[A-Z][a-z]+")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)\x20$")
_NAME_BEFORE = re.compile(r"[A-Za-z]+$")
_DOT = re.compile(r"\x20dot\x20", re.I)
_DOTTED_DIGITS = re.compile(r"(?<=[0-9])\x20(?:dot|point|punkt|punto)\x20(?=[0-9])", re.I)
_TRIGGER = re.compile(rf"[\[({{<]\x20?(?:at|@|dot|punkt|point|punto|\.)\x20?[\])}}>]|\x20(?:dot|point|punkt|punto)\x20|\x20at\x20[A-Za-z0-9-]+\.[A-Za-z0-9]|[-_*~]at[-_*~]|\x20(?:arroba|arobase|klammeraffe)\x20|\x20@|@\x20|\x20\.\x20|{_LOOKALIKE.pattern}", re.I)

Span = tuple[int, int]


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "").translate({40: None, 41: None, 43: None, 46: None})


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping: each @ takes the whole run before it, back to the last match."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def detect(text: str) -> dict[str, list[Span]]:
    """The plain identifiers of each kind; matches that fail their test are dropped without another try."""
    found: dict[str, list[Span]] = {}
    if "@" in text:
        found["email"] = list(_emails(text))
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if len(m[0]) >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return found


class Rewritten:
    """A text after some rewritings, with the source span of each of its pieces: (place here, source start, source end)."""

    def __init__(self, text: str):
        self.text = text
        self.pieces: list[tuple[int, int, int]] = []  # of rewritten parts; between them characters map one to one
        self.sizes: list[int] = []  # their lengths here

    def source(self, at: int, end: bool) -> int:
        """The source offset of a place here; as an end it takes in a rewritten piece whole."""
        k = bisect_right(self.pieces, (at - 1 if end else at, 1 << 62)) - 1
        if k < 0:
            return at
        (place, start, stop), size = self.pieces[k], self.sizes[k]
        inside = at - place
        if inside < size or (end and inside <= size):
            return stop if end else start
        return stop + inside - size

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Edits (start, end, new), in order and apart, in places of this text."""
        if not edits:
            return self
        out, parts, at, shift = Rewritten(""), [], 0, 0
        new: list[tuple[int, int, int, int]] = []
        old = [(p, s, a, b) for (p, a, b), s in zip(self.pieces, self.sizes, strict=True)]
        k = 0
        for start, end, text in edits:
            while k < len(old) and old[k][0] + old[k][1] <= start:
                new.append((old[k][0] + shift, old[k][1], old[k][2], old[k][3]))
                k += 1
            a, b = self.source(start, False), self.source(end, True)
            while k < len(old) and old[k][0] < end:
                a, b = min(a, old[k][2]), max(b, old[k][3])
                k += 1
            new.append((start + shift, len(text), a, b))
            parts += [self.text[at:start], text]
            shift += len(text) - (end - start)
            at = end
        new += [(p + shift, s, a, b) for p, s, a, b in old[k:]]
        out.text = "".join([*parts, self.text[at:]])
        out.pieces, out.sizes = [(p, a, b) for p, _, a, b in new], [s for _, s, _, _ in new]
        return out

    def touched(self, start: int, end: int) -> bool:
        k = bisect_right(self.pieces, (end - 1, 1 << 62)) - 1
        return k >= 0 and self.pieces[k][0] + max(1, self.sizes[k]) > start


def _is_prose(text: str, m: re.Match) -> bool:
    """Whether "name at host.end" is prose by its words: no end of a domain, a short number, or a word that is no name there."""
    name, host = text[m.start() : m.start(1)], text[m.end(1) : m.end()]
    end = re.split(r"[.\x20]", host)[-1]
    if _DOT.search(host) and end.lower() in DOMAIN_ENDS:
        return False
    if not _DOMAIN_END.fullmatch(end) or _NEW_SENTENCE.fullmatch(host) or (name.isdigit() and len(name) <= 4) or name.lower() in PROSE:
        return True
    before = _WORD_BEFORE.search(text, max(0, m.start() - 24), m.start())
    return before is not None and name.isalpha() and before[1].lower() in BEFORE_PROSE


def rewrite(text: str) -> Rewritten:
    """All transducers, one after another."""
    r = Rewritten(text)
    r = r.apply([(m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _LOOKALIKE.finditer(r.text)])
    r = r.apply([(m.start(), m.end(), "".join(_SPELLED_SIGN.get(w.lower()) or SPELLED[w.lower()] for w in _SPELLED_WORD.findall(m[0]))) for m in _SPELLED.finditer(r.text)])
    r = r.apply([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(r.text)])
    r = r.apply([(m.start(), m.end(), ".") for m in _DOTTED_DIGITS.finditer(r.text)])
    for pattern in _SIGNED:
        edits = []
        for m in pattern.finditer(r.text):
            name = _NAME_BEFORE.search(r.text, max(0, m.start() - 24), m.start())
            if (m["at"] != "@" or " " in m["host"]) and not ("@" in m["at"] and name and name[0].lower() in PROSE):
                dots = [(d.start(), d.end(), ".") for d in _SIGNED_DOT.finditer(r.text, *m.span("host")) if d[0] != "."]
                edits += ([(*m.span("at"), "@")] if m["at"] != "@" else []) + dots
        r = r.apply(edits)
    edits = []
    for m in _NAMED.finditer(r.text):
        dots = [d for d in _DOT.finditer(r.text, m.start(), m.end())]
        if m[1] == "@" and not dots or m[1] != "@" and _is_prose(r.text, m):
            continue
        edits += sorted([(d.start(), d.end(), ".") for d in dots] + ([(m.start(1), m.end(1), "@")] if m[1] != "@" else []))
    return r.apply(edits)


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of every identifier, by start and then kind."""
    if not text:
        return []
    base = detect(text)
    spans = [(kind, a, b, True) for kind, own in base.items() for a, b in own]
    if _TRIGGER.search(text) or _SPELLED.search(text):
        r = rewrite(text)
        if r.pieces:
            for kind, own in detect(r.text).items():
                plain = base.get(kind, [])  # in order and apart, so one alone can cover a start
                starts = [s for s, _ in plain]
                for a, b in own:
                    if r.touched(a, b):
                        start, end = r.source(a, False), r.source(b, True)
                        k = bisect_right(starts, start) - 1
                        if k < 0 or plain[k][1] < end:
                            spans.append((kind, start, end, False))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:long,end:long,plain:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def spans(text: Column) -> Column:
    """The identifiers of each whole text, as an array of (kind, start, end, plain): code points, end exclusive.

    Null and empty texts have none. `plain` ones are those of the text as it is; the others were disguised,
    and each covers something that no plain one of its kind does, which it may overlap. Spans of one start go
    by kind and then end. The array depends on the text alone, so repeated rows have equal ones, whatever
    their other columns hold and are called; the time grows in proportion to the text.
    """

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in find(t.as_py())] for t in texts], _SPANS)

    return found(text)
