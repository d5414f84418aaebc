"""Personal data in texts by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds its anchors: at-signs, plus signs, digits, URL schemes and words that
announce an identifier. Around each anchor a local parser expands to the left and right and validates what it has: e-mail
addresses, network addresses, card numbers, telephone numbers, bank accounts. Parsers go over a text from left to right and
never look at a character more than a few times, whatever the text.

The plain patterns (base) are leftmost, greedy and don't overlap within a kind; a match that fails its check is dropped with
all it has swallowed. Expansion then adds what validated boundaries tell:

- a telephone number that ran into the digits after it, ended where its own groups end;
- a card number inside a longer chain of digits: one group, or groups of 4-4-4-4 or 4-6-5, with an issuer's first digit;
- an e-mail address whose name or host has letters beyond ASCII, from its first letter on;
- an e-mail address written with "(at)" or "[at]", and "(dot)" or "[dot]";
- user names before a host in URLs that have no dot (scheme://name:word@host), as far as the host;
- after a word such as "phone" or "account", a national telephone number, or an account's digits;
- international bank account numbers whose check digits hold.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import text as T

#: Kinds in the order in which spans with equal starts stand; the last is only ever added.
KINDS = ("email", "ip", "card", "phone", "account")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Words that announce a telephone number or an account, as they are written in lower case.
PHONE_CUES = ("phone", "tel", "telephone", "mobile", "fax", "telefon", "téléphone", "teléfono", "móvil")
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte")
AT_CUES = ("(at)", "[at]", "{at}")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_SPELT_DOMAIN = re.compile(r"[ ]?([A-Za-z0-9-]+(?:(?:\.|[ ]?[(\[{]dot[)\]}][ ]?)[A-Za-z0-9-]+)*(?:\.|[ ]?[(\[{]dot[)\]}][ ]?)[A-Za-z]{2,24})(?![A-Za-z0-9])", re.I)
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_CALL = re.compile(r"[ ().0-9-]+")
_NATIONAL = re.compile(r"(?:\(?[0-9]{2,5}\)?[ ./-]?)?[0-9]{2,8}(?:[ .-][0-9]{2,8}){0,4}")
_NUMBER = re.compile(r"[0-9]{2,}(?:[ -]?[0-9]{2,})*")
_SAYS = re.compile(r"(?:\s*(?:no\.?|number|nr\.?|num\.?|n°|#))?\s{0,2}[:=.]?\s{0,2}", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_HOST = re.compile(r"[A-Za-z0-9-]+(?![A-Za-z0-9.-])")


@cache
def _anchors() -> ahocorasick.Automaton:
    """All anchors. Words stand in three spellings; each knows its kind and length."""
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, words in (("call", PHONE_CUES), ("account", ACCOUNT_CUES), ("spelt", AT_CUES)):
        for w in words:
            for spelling in {w, w.upper(), w.capitalize()}:
                a.add_word(spelling, (kind, len(spelling)))
    a.add_word("IBAN", ("iban", 4))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _count(s: str) -> int:
    """Digits of ASCII in s."""
    return sum(c in DIGITS for c in s)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


class Parsers:
    """Local parsers over one text. base and added: sets of (start, kind's number, end)."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.base: set[tuple[int, int, int]] = set()
        self.added: set[tuple[int, int, int]] = set()
        self.mail = self.chain = self.dotted = 0  # where the last e-mail, chain of digits and dotted chain end
        self.wide = 0

    def add(self, kind: int, start: int, end: int) -> None:
        self.added.add((start, kind, end))

    def digit(self, i: int) -> None:
        if i >= self.chain:
            self.cards(_CHAIN.match(self.text, i))
        if i >= self.dotted:
            self.addresses(_DOTTED.match(self.text, i))

    def cards(self, m: re.Match) -> None:
        self.chain = m.end()
        if m.end() - m.start() < 12:
            return
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            self.base.add((m.start(), 2, m.end()))
            return
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(self.text, m.start(), m.end())]
        for k, (a, z) in enumerate(groups):
            if 13 <= z - a <= 19:
                self.card(a, z)
            for shape in ((4, 4, 4, 4), (4, 6, 5)):
                some = groups[k : k + len(shape)]
                if tuple(e - s for s, e in some) == shape:
                    self.card(a, some[-1][1])

    def card(self, a: int, z: int) -> None:
        digits = _digits(self.text[a:z])
        if digits[0] in "23456" and luhn(digits):
            self.add(2, a, z)

    def addresses(self, m: re.Match) -> None:
        self.dotted = m.end()
        if m.end() - m.start() < 7:
            return
        parts = [(p.start(), p.end()) for p in _GROUP.finditer(self.text, m.start(), m.end())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(z - a <= 3 or not self.text[a : z - 3].strip("0") for a, z in four) and all(int(self.text[max(a, z - 3) : z]) <= 255 for a, z in four):
                self.base.add((four[0][0], 1, four[3][1]))

    def at(self, i: int) -> None:
        start = i
        while start > self.mail and self.text[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(self.text, i + 1)
        if m and start < i:
            self.base.add((start, 0, m.end()))
            self.mail = m.end()
        self.wide_mail(i)

    def wide_mail(self, i: int) -> None:
        """The same with letters of any script, where that makes a difference."""
        start = i
        while start > self.wide and (self.text[start - 1] in LOCAL or (self.text[start - 1] > "\x7f" and self.text[start - 1].isalnum())):
            start -= 1
        while start < i and not self.text[start].isalnum():
            start += 1
        m = _WIDE_DOMAIN.match(self.text, i + 1)
        if not m or start == i:
            return
        self.wide = m.end()
        if not self.text[start : m.end()].isascii():
            self.add(0, start, m.end())

    def plus(self, i: int) -> None:
        if i + 1 >= self.n or self.text[i + 1] not in DIGITS:
            return
        m = _CALL.match(self.text, i + 2)
        end = m.end() if m else i + 2
        while end > i + 2 and self.text[end - 1] not in DIGITS:
            end -= 1
        if end < i + 4:
            return
        digits = _count(self.text[i:end])
        if 9 <= digits <= 15:
            self.base.add((i, 3, end))
        elif digits > 15:
            self.cut_call(i, end)

    def cut_call(self, i: int, end: int) -> None:
        """The longest whole groups with no more digits than a number has, if what follows begins a group of its own."""
        best, digits = 0, 0
        for g in _GROUP.finditer(self.text, i, end):
            digits += g.end() - g.start()
            if digits > 15:
                break
            if digits >= 9 and self.text[g.end() : g.end() + 1] == " " and self.text.count("(", i, g.end()) == self.text.count(")", i, g.end()):
                best = g.end()
        if best:
            self.add(3, i, best)

    def announced(self, i: int, length: int, pattern: re.Pattern, kind: int, least: int, most: int) -> None:
        """A number after a word that ends before i, which no letter precedes."""
        if i > length and self.text[i - length - 1].isalpha():
            return
        m = pattern.match(self.text, _SAYS.match(self.text, i).end())
        if m and least <= _count(m.group()) <= most and not self.text[m.end() : m.end() + 1].isalnum():
            self.add(kind, m.start(), m.end())

    def spelt(self, i: int, length: int) -> None:
        """name (at) host (dot) domain; i is behind the anchor."""
        end = i - length
        while end > 0 and self.text[end - 1] == " " and end > i - length - 1:
            end -= 1
        start = end
        while start > self.mail and self.text[start - 1] in LOCAL:
            start -= 1
        m = _SPELT_DOMAIN.match(self.text, i)
        if m and start < end:
            self.add(0, start, m.end(1))

    def scheme(self, i: int) -> None:
        """name:word@host behind ://, for hosts without a dot."""
        end = i
        while end < self.n and (self.text[end] in LOCAL or self.text[end] == ":"):
            end += 1
        if end == i or end >= self.n or self.text[end] != "@":
            return
        m = _HOST.match(self.text, end + 1)
        if m and ":" in self.text[i:end]:
            self.add(0, i, m.end())

    def iban(self, i: int) -> None:
        m = _IBAN.match(self.text, _SAYS.match(self.text, i).end())
        if m:
            plain = m.group().replace(" ", "")
            if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                self.add(4, m.start(), m.end())

    def run(self) -> Parsers:
        for last, (kind, length) in _anchors().iter(self.text):
            if kind == "digit":
                if last >= self.chain or last >= self.dotted:
                    self.digit(last)
            elif kind == "at":
                self.at(last)
            elif kind == "plus":
                self.plus(last)
            elif kind == "scheme":
                self.scheme(last + 1)
            elif kind == "call":
                self.announced(last + 1, length, _NATIONAL, 3, 7, 15)
            elif kind == "account":
                self.announced(last + 1, length, _NUMBER, 4, 6, 20)
            elif kind == "spelt":
                self.spelt(last + 1, length)
            else:
                self.iban(last + 1)
        self.added -= self.base
        return self


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def spans_of(text: str) -> list[dict]:
    """All spans of a text in the order of starts, kinds and ends."""
    p = Parsers(text).run()
    every = [(*s, True) for s in p.base] + [(*s, False) for s in p.added]
    return [{"kind": KINDS[k], "start": s, "end": e, "base": own} for s, k, e, own in sorted(every)]


def masked(text: str, spans: list[dict]) -> str:
    """The text with [KIND] in place of each stretch that spans cover, after the first of them."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end, base; places in code points, end exclusive), in the
    order of starts, kinds and ends; and with_text, text as masked() leaves it.

    base: whether a plain pattern found it; added spans may overlap base ones, which stay. Null and empty texts have no
    span, and stay. Null and repeated ids and repeated rows each give a row. An empty table gives an empty result.
    """
    common.ship(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), T.texts_of(b)
            for lo, hi in T.chunks(texts):
                some = [None if t is None else t.decode() for t in texts[lo:hi]]
                spans = [spans_of(t or "") for t in some]
                made = [ids.slice(lo, hi - lo), pa.array(spans, pa.list_(_SPAN))]
                if with_text:
                    made.append(pa.array([None if t is None else masked(t, s) for t, s in zip(some, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "spans", "text"][: len(made)])

    return named.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>" + (", text string" if with_text else ""))


def digest(found: DataFrame) -> DataFrame:
    """From rows of find(): doc_id, how many base spans of each kind, the digest of all base spans as kind:start:end, and all
    spans so."""
    of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(of(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), of("spans").alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with [KIND] in place of personal data."""
    return find(docs, id_col=id_col, text_col=text_col, with_text=True).select("doc_id", "text")
