"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and cues, and local parsers expand each to a checked span."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import pieces, small_batches

#: Kinds in the order that breaks ties of start; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "url_login", "account"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN_END = re.compile(r"[/ \t\n\r\x0b\x0c<>\"']")
SCHEMES = ["http://", "https://", "ftp://", "ssh://"]
CUES = ["iban", "ssn", "account", "acct", "passport", "konto", "compte", "cuenta", "social security"]
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9A-Za-z])")
BETWEEN = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|num\.?|#|is|:|=))*[ \t]*", re.I)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("digit", list("0123456789")), ("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str, signs: list[int]) -> list[tuple[int, int]]:
    """From each at-sign left over the local part, right over the domain. A sign whose domain fails can't match from any other start, so this is the leftmost match."""
    found, last = [], 0
    for at in signs:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if at >= last and start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
    return found


def address(run: str, at: int) -> list[tuple[int, int]]:
    """Every four parts of a run of dotted numbers that begins at `at`, if all are at most 255."""
    found = []
    if run.count(".") < 3:
        return found
    parts = run.split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in four):
            found.append((at, at + size))
        at += size + 1
    return found


def is_card(run: str) -> bool:
    return 12 <= len(digits := run.replace(" ", "").replace("-", "")) <= 19 and luhn(digits)


def is_phone(run: str) -> bool:
    return 9 <= sum(map(str.isdigit, run)) <= 15


def login(text: str, after: int, start: int) -> tuple[int, int] | None:
    """scheme://user:password@host: the part up to the at-sign, which must come before any slash or space. Every scheme ends in a slash, so no part of the text is looked at twice."""
    end = m.start() if (m := LOGIN_END.search(text, after)) else len(text)
    at = text.rfind("@", after, end)
    return (start, at) if at > after and ":" in text[after:at] else None


def account(text: str, after: int) -> tuple[int, int] | None:
    """An IBAN whose check digits hold, or a number of 6 to 18 digits, right after a cue."""
    at = BETWEEN.match(text, after).end()
    if m := IBAN.match(text, at):
        code = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return m.span()
    return m.span() if (m := NUMBER.match(text, at)) else None


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted; offsets in code points, ends exclusive.

    One pass of the automaton. Each anchor is expanded where it stands; an anchor inside what its kind has already
    read is passed over, whether that was a match or not, so every kind reads the text at most once.
    """
    signs, out = [], []
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    dotted = card = phone = 0  # how far each kind has read
    for end, (kind, size) in automaton().iter(low):
        if kind == "digit":
            if end >= dotted:
                m = DOTTED.match(text, end)
                dotted = m.end()
                out += [(a, 1, b) for a, b in address(m[0], end)]
            if end >= card and (m := CARD.match(text, end)):
                card = m.end()
                if is_card(m[0]):
                    out.append((end, 2, card))
        elif kind == "+":
            if end >= phone and (m := PHONE.match(text, end)):
                phone = m.end()
                if is_phone(m[0]):
                    out.append((end, 3, phone))
        elif kind == "@":
            signs.append(end)
        elif kind == "scheme":
            if x := login(text, end + 1, end + 1 - size):
                out.append((x[0], 4, x[1]))
        elif (end + 1 == len(text) or not text[end + 1].isalpha()) and (end < size or not text[end - size].isalnum()) and (x := account(text, end + 1)):
            out.append((x[0], 5, x[1]))
    out += [(a, 0, b) for a, b in emails(text, signs)]
    return sorted(set(out))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url_login, n_account) for every row.

    Null and empty texts have no spans. Spans of different kinds may overlap. Rows are searched each by itself, whole,
    so repeated rows agree; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, texts_out = [], []
            for _, texts in pieces(batch.column("text")):
                for text in pc.fill_null(texts, "").to_numpy(zero_copy_only=False):
                    found = spans(text)
                    for k, column in enumerate(counts):
                        column.append(sum(x[1] == k for x in found))
                    digests.append(hashlib.sha256(written([x for x in found if x[1] < 4]).encode()).hexdigest())
                    texts_out.append(written(found))
            n = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *n[:4], pa.array(digests, pa.string()), pa.array(texts_out, pa.string()), *n[4:]], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:])])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url_login long, n_account long")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and then the longest."""
    out, last = [], 0
    for a, k, b in sorted(spans(text or ""), key=lambda x: (x[0], -x[2])):
        if a >= last:
            out += [text[last:a], f"<{KINDS[k]}>"]
            last = b
    return "".join(out) + (text or "")[last:]
