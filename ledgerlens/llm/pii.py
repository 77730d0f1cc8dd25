"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, schemes and identifier cues in one pass over a text; at each
anchor a local parser expands to the span's boundaries and validates it. Digit groups are their own anchors (addresses
of four numbers, card numbers). Every parser is linear in the text, also for runs of a hundred thousand digits.

Kinds, in this order: email, ip, card, phone (the fixed base patterns, leftmost and non-overlapping within a kind),
then address (a URL that carries user information) and account (validated numbers after an identifier cue).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import by_batch

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
#: Words after which an account or identity number may stand; matched in lower, upper and title case at word boundaries.
CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "kontonummer", "compte", "cuenta", "customer id", "member id", "tax id")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A start inside a digit run can only match where the run's first digit matches too, so later starts are skipped.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = {ord(c): None for c in " -().+"}
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_CUE_TAIL = re.compile(r"(?:[ _]?(?:no|nr|num|number|id)\b\.?)?[ ]{0,2}[:#=]?[ ]{0,2}", re.ASCII | re.IGNORECASE)
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,17}", re.ASCII)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for s in SCHEMES:
        for w in (s, s.upper()):
            a.add_word(w, ("scheme", len(w)))
    for c in CUES:
        for w in {c, c.upper(), c.capitalize(), c.title()}:
            a.add_word(w, ("cue", len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _address(text: str, start: int, at: int) -> tuple[int, int] | None:
    """A URL from its scheme at ``start``, its authority at ``at``: only with user information before an at-sign."""
    m = _URL.match(text, at)
    if not m:
        return None
    end = m.end()
    while end > at and text[end - 1] in ".,;:!?)]":
        end -= 1
    authority = re.split(r"[/?#]", text[at:end], maxsplit=1)[0]
    user, sep, host = authority.rpartition("@")
    return (start, end) if sep and user and "." in host.strip(".") else None


def _account(text: str, start: int, at: int) -> tuple[int, int] | None:
    """The number after a cue that ends at ``at``: an IBAN whose checksum holds, or 6 to 18 digits."""
    if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        return None
    m = _ACCOUNT.match(text, _CUE_TAIL.match(text, at).end())
    if not m or m.start() == at:
        return None
    found, end = m.group(), m.end()
    if found[0].isalpha():
        while found and not iban_valid(found.replace(" ", "")):
            cut = found.rfind(" ")
            found = found[:cut] if cut > 15 else ""
        if not found:
            return None
        end = m.start() + len(found)
    if end < len(text) and text[end].isalnum():
        return None
    return m.start(), end


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, in code points, by start and then in the order of KINDS."""
    out: list[tuple[int, int, int]] = []
    email_end = phone_end = 0
    for last, (what, n) in automaton().iter(text):
        at = last + 1
        if what == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, at)):
                email_end = m.end()
                out.append((start, email_end, 0))
        elif what == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= len(m.group().translate(_NO_DIGITS)) <= 15:
                    out.append((last, phone_end, 3))
        elif what == "scheme":
            if (last - n < 0 or not text[last - n].isalpha()) and (span := _address(text, at - n, at)):
                out.append((*span, 4))
        elif span := _account(text, at - n, at):
            out.append((*span, 5))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().translate(_NO_DIGITS)
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    out = sorted(set(out), key=lambda s: (s[0], s[2], s[1]))
    return [(s, e, KINDS[k]) for s, e, k in out]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str) -> str:
    """Replaces what the spans cover by the kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    spans = find(text)
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if spans else text


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of each whole text; one row per input row, no shuffle.

    Null and empty texts have no spans (digest of the empty string). Repeated rows give equal rows; columns other than
    the two named are not read; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(1).to_pylist():
            spans = find(t) if t else []
            n = {k: 0 for k in BASE}
            base = [s for s in spans if s[2] in n]
            for s in base:
                n[s[2]] += 1
            rows.append((*n.values(), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = dict(docs.dtypes)[key]
    return by_batch(docs.select(key, text), run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_texts(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with spans replaced in ``text`` and, where that column exists, ``n_chars`` counted anew.

    A null text stays null with a null count; empty texts and texts without spans stay as they are. Repeated rows give equal
    rows, other columns come out untouched whatever their names, and an empty table gives no rows."""
    has_count = n_chars in docs.columns if n_chars else False
    i = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [t if t is None else redact(t) for t in batch.column(i).to_pylist()]
        out = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
        if has_count:
            j = docs_columns.index(n_chars)
            out = out.set_column(j, out.schema.field(j), pa.array([None if t is None else len(t) for t in new], out.schema.field(j).type))
        return out

    docs_columns = docs.columns
    return by_batch(docs, run, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes))
