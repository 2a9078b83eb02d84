"""Personal data, plain and disguised, at exact source positions.

Plain identifiers are found in the text as it is.  Disguised ones are found by *transducers*: each reads a text and
writes a normalised one, and remembers for every written stretch the stretch it was read from.  One maps homoglyphs
(other scripts' look-alikes, full-width and styled digits, dashes, invisible characters), one writes spelled digits as
digits, one writes "(at)", "[dot]", "name at host dot org" as the signs.  The same detectors run over the normalised
text, and what they find is mapped back.  Such a span is added if a transducer changed something in it and it overlaps
no plain span.  One that reaches beyond the plain spans it overlaps is *wider*: it stands beside them.

Transducers run over every text; where they rewrite nothing, nothing is disguised.  Prose has "at", "dot" and spelled digits,
too: the words are signs only where what follows reads as a host, which ends in a known label or in a number, and a number
after "version", "section" or the like is no address.

Defined cases: null text counts as empty and has no span; offsets are code points, ends exclusive; kinds may overlap
each other, a kind overlaps itself only where a wider span stands beside a plain one; repeated rows are treated each;
other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The patterns of the four kinds.  A match of an ip begins where a run of digits does, and no run is read
# twice for a failure: long runs cost one pass.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Look-alikes of Latin letters, digits and signs.
_LOOK = "аеорсхуіѕјԁһԛԝАВЕКМНОРСТХУІЅЈοανικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LIKE = "aeopcxyisjdhqwABEKMHOPCTXYISJoavikptuABEZHIKMNOPTYX"
_HOMOGLYPHS: dict[int, str | None] = {ord(a): b for a, b in zip(_LOOK, _LIKE)}
_HOMOGLYPHS |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full width
_HOMOGLYPHS |= {c: str((c - 0x1D7CE) % 10) for c in range(0x1D7CE, 0x1D800)}  # styled digits
_HOMOGLYPHS |= {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966) for d in range(10)}
_HOMOGLYPHS |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212)}
_HOMOGLYPHS |= {c: " " for c in (0x00A0, 0x2007, 0x2009, 0x202F)} | {0xFE6B: "@", 0x2024: ".", 0x3002: ".", 0xFF0E: "."}
_HOMOGLYPHS |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_HAS_HOMOGLYPH = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_HOMOGLYPHS)))) + "]")

# Spelled digits in four languages.
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ -]+)?(?:{_WORD})(?:[ ,-]{{1,2}}(?:{_WORD}))*(?!\w)")
_SPELLED_ONE = re.compile(rf"(?i)plus|{_WORD}")

_OPEN, _CLOSE = r"[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]"
_AT_SIGN = re.compile(rf"(?i)\s{{0,3}}{_OPEN}(?:at|@){_CLOSE}\s{{0,3}}")
_DOT_SIGN = re.compile(rf"(?i)\s{{0,3}}{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}\s{{0,3}}")
# The last labels of hosts that words may spell.  Those of the second line are words, too: they count where
# "dot" is spelled, and not after a full stop, which may end a sentence.
_HOST_ENDS = frozenset("com org net edu gov mil int info biz name pro io co ai app dev xyz online site shop eu uk de fr es ch nl se fi pl cz ru br mx ar jp cn kr nz za ca au".split())
_WORD_ENDS = _HOST_ENDS | frozenset("it in us me no be at is to my so am as by do tv la si cc".split())
_BETWEEN = r"(?:\s{1,3}dot\s{1,3}|\.)"
_HOST = re.compile(rf"(?i)([a-z0-9-]+){_BETWEEN}[a-z0-9-]+(?:{_BETWEEN}[a-z0-9-]+)*")
_LABEL = re.compile(r"(?i)[a-z0-9-]+")
_DOT = re.compile(r"(?i)\s{1,3}dot\s{1,3}")
_AT_WORD = re.compile(rf"(?i)(?<=[a-z0-9])\s{{1,3}}at\s{{1,3}}(?=[a-z0-9-]+{_BETWEEN}[a-z0-9-])")
_DOT_WORD = re.compile(r"(?i)(?<=[a-z0-9-])\s{1,3}dot\s{1,3}(?=[a-z0-9-])")
# Words before a number that is no address though dots are in it.
_NUMBERED = re.compile(r"(?i)(?:version|release|build|section|chapter|part|step|figure|table|item|rule|clause|level|vers|sección|abschnitt|kapitel|chapitre|versión)[\s.:#]{1,3}$")


def _emails(text: str) -> list[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@`` and a domain: found from each @ outwards."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            found.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return found


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Spans of the four kinds in the text as it is, by start, then kind."""
    found = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Transduced:
    """A text under rewriting.  ``starts``: where each stretch begins; ``source``: the stretch of the source it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = [0]
        self.source: list[tuple[int, int, bool]] = [(0, len(text), False)]

    def _at(self, i: int) -> int:
        return bisect_right(self.starts, i) - 1

    def to_source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Source positions of the written stretch, and whether anything in it was rewritten."""
        x, y = self._at(a), self._at(b - 1)
        first, last = self.source[x], self.source[y]
        start = first[0] if first[2] else first[0] + a - self.starts[x]
        end = last[1] if last[2] else last[0] + b - self.starts[y]
        return start, end, any(s[2] for s in self.source[x : y + 1])

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Applies ascending, disjoint changes (start, end, new text) to the present text."""
        if not changes:
            return
        parts, starts, source, size, at = [], [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                k = self._at(a)
                stop = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                s = self.source[k]
                starts.append(size)
                source.append(s if s[2] else (s[0] + a - self.starts[k], s[0] + stop - self.starts[k], False))
                parts.append(self.text[a:stop])
                size += stop - a
                a = stop

        for a, b, new in changes:
            copy(at, a)
            s, e, _ = self.to_source(a, b)
            if new:
                starts.append(size)
                source.append((s, e, True))
                parts.append(new)
                size += len(new)
            else:  # what vanished counts as a change of what follows it
                starts.append(size)
                source.append((s, e, True))
            at = b
        copy(at, len(self.text))
        self.text, self.starts, self.source = "".join(parts), starts or [0], source or [(0, 0, False)]


def _homoglyphs(t: Transduced) -> None:
    t.rewrite([(m.start(), m.end(), _HOMOGLYPHS[ord(m[0])] or "") for m in _HAS_HOMOGLYPH.finditer(t.text)])


def _digits(t: Transduced) -> None:
    def written(run: str) -> str:
        return "".join("+" if w == "plus" else str(SPELLED[w]) for w in map(str.lower, _SPELLED_ONE.findall(run)))

    t.rewrite([(m.start(), m.end(), written(m[0])) for m in _SPELLED_RUN.finditer(t.text)])


def _in_hosts(text: str, words: re.Pattern[str]) -> list[re.Match[str]]:
    """The words that stand before, or in, what reads as a host: labels that end in a known one (dots: or in a number).  A host is
    read once, however many of its dots are spelled."""
    kept: list[re.Match[str]] = []
    end, known = -1, False
    for m in words.finditer(text):
        if m.end() >= end:
            host = _HOST.match(text, m.end())
            end = host.end() if host else _LABEL.match(text, m.end()).end()
            last = re.split(r"[.\s]", text[m.end() : end])[-1].lower()
            spelled = words is _DOT_WORD or host is not None and _DOT.search(host[0]) is not None
            known = last in (_WORD_ENDS if spelled else _HOST_ENDS) or words is _DOT_WORD and last.isdigit()
        if known:
            kept.append(m)
    return kept


def _signs(t: Transduced) -> None:
    """Signs in brackets are disguises by themselves, words only where a host follows: prose has "at" and "dot", too."""
    for pattern, sign in ((_AT_SIGN, "@"), (_DOT_SIGN, ".")):
        t.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(t.text)])
    for words, sign in ((_AT_WORD, "@"), (_DOT_WORD, ".")):
        t.rewrite([(m.start(), m.end(), sign) for m in _in_hosts(t.text, words)])


def disguised_spans(text: str, plain: list[Span]) -> tuple[list[Span], list[Span]]:
    """Spans that show only after normalisation, in source positions: those apart from plain ones, and the wider ones."""
    t = Transduced(text)
    if not text.isascii():
        _homoglyphs(t)
    _digits(t)
    _signs(t)
    added: list[Span] = []
    wider: list[Span] = []
    if t.text is text:  # nothing was rewritten
        return added, wider
    for kind, a, b in plain_spans(t.text):
        start, end, changed = t.to_source(a, b)
        if not changed or any(k == kind and s < end and start < e for k, s, e in added + wider):
            continue
        if kind == "ip" and _NUMBERED.search(text, max(0, start - 16), start):
            continue
        met = [(s, e) for _, s, e in plain if s < end and start < e]
        if not met:
            added.append((kind, start, end))
        elif not any(s <= start and end <= e for s, e in met):
            wider.append((kind, start, end))
    return added, wider


def find_each(texts: list[str | None]) -> list[tuple[list[Span], list[Span], list[Span]]]:
    """Plain, added and wider spans of each text."""
    out = []
    for text in (t or "" for t in texts):
        plain = plain_spans(text)
        out.append((plain, *disguised_spans(text, plain)))
    return out


def find_all(texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """Plain and added spans of each text."""
    return [(plain, added) for plain, added, _ in find_each(texts)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``: counts and ``spans`` are of all spans."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, (plain, added, wider) in zip(b.column(0).to_pylist(), find_each(b.column(1).to_pylist())):
            spans = ordered(plain + added + wider)
            counts = [sum(s[0] == k for s in spans) for k in KINDS]
            rows.append((key, *counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(spans), len(spans)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    columns = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, columns)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, or chain of overlapping spans, becomes its first kind's mark."""
    parts, at = [], 0
    for kind, a, b in ordered(spans):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span's text replaced, and the length column set anew; all columns stay, null texts stay null."""
    schema = docs.schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.schema.get_field_index(text_col)
        texts = b.column(at).to_pylist()
        new = [t if t is None else redacted(t, p + a + w) for t, (p, a, w) in zip(texts, find_each(texts))]
        columns = list(b.columns)
        columns[at] = pa.array(new, b.schema.field(at).type)
        if n_chars_col in b.schema.names:
            k = b.schema.get_field_index(n_chars_col)
            old = columns[k].to_pylist()
            columns[k] = pa.array([o if t is None else len(t) for o, t in zip(old, new)], b.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_batches(docs, run, schema)
