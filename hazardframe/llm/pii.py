"""Personal data: an automaton finds anchors, local parsers expand and validate them.

The Aho-Corasick automaton gives at-signs, plus signs, schemes and identifier
cues. From an at-sign the parser expands left over the local part and right over
the domain; from a plus sign it reads a phone number; from a cue it reads the
account behind it. Addresses of four numbers and card numbers start at a run of
digits, which is their anchor. Every parser starts no earlier than the end of the
last match of its kind, so the result equals a leftmost scan.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from hazardframe.llm.common import map_rows, spread, text_of, type_of
from hazardframe.llm.secrets import ascii_lower, joined

#: Kinds in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "account", "profile")
ORDER = {kind: i for i, kind in enumerate(BASE_KINDS + EXTRA_KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never ends inside a run of digits, so the look-behind only spares attempts.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\bIBAN[:\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.I | re.A)
ACCOUNT = re.compile(r"(?:account|acct)[:.#\x20]{1,3}(?:no\.?|number)?[:.#\x20]{0,3}([0-9]{6,17})(?![0-9A-Za-z])", re.I | re.A)
PROFILE = re.compile(r"https?://[A-Za-z0-9.-]+/(?:~|@|user/|users/|u/|in/|profile/)([A-Za-z0-9._-]+)")
#: Anchor (lower case) and the kind whose parser it starts.
CUES = {"@": "email", "+": "phone", "iban": "iban", "account": "account", "acct": "account", "http://": "profile", "https://": "profile"}
PARSERS = {"phone": PHONE, "iban": IBAN, "account": ACCOUNT, "profile": PROFILE}


@cache
def _automaton():
    found = ahocorasick.Automaton()
    for cue, kind in CUES.items():
        found.add_word(cue, (len(cue), kind))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    code = code.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in match[0].split("."))
    if kind == "card":
        digits = match[0].replace(" ", "").replace("-", "")
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= sum("0" <= c <= "9" for c in match[0]) <= 15
    if kind == "iban":
        return iban_holds(match[1])
    return True


def find_pii(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of personal data, in code points, by kind as listed, then start."""
    spans: list[tuple[str, int, int]] = []
    ends: dict[str, int] = {}
    for end, (size, kind) in _automaton().iter(ascii_lower(text)):
        start = end - size + 1
        if start < (least := ends.get(kind, 0)):
            continue
        if kind == "email":
            left = start
            while left > least and text[left - 1] in LOCAL:
                left -= 1
            match = DOMAIN.match(text, start) if left < start else None
            if match:
                ends[kind] = match.end()
                spans.append((kind, left, match.end()))
        elif match := PARSERS[kind].match(text, start):
            ends[kind] = match.end()
            if _holds(kind, match):
                spans.append((kind, start, match.end()))
    for kind, expression in (("ip", IP), ("card", CARD)):
        spans += [(kind, *m.span()) for m in expression.finditer(text) if _holds(kind, m)]
    spans.sort(key=lambda s: (ORDER[s[0]], s[1]))
    return spans


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and its ``spans`` (kind, start, end).

    A null text counts as empty; an empty text has no spans; a null id stays
    null; repeated rows are each scanned, very long texts whole, and an empty
    table gives an empty one. Spans that tie in their start are ordered by kind.
    Further columns are never read, whatever their names.
    """

    def kernel(ids, texts):
        found = [find_pii(x) for x in texts]
        return {
            id_col: ids,
            "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found],
        }

    schema = f"`{id_col}` {type_of(docs, id_col)}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(spread(docs.select(id_col, text_of(text_col).alias("text"))), schema, kernel)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of what :func:`scan_pii` finds, one row per document."""

    def kernel(ids, spans):
        found = [[(s["kind"], s["start"], s["end"]) for s in x] for x in spans]
        base = [[s for s in x if s[0] in BASE_KINDS] for x in found]
        made = {id_col: ids}
        for kind in BASE_KINDS:
            made[f"n_{kind}"] = [sum(s[0] == kind for s in x) for x in base]
        made["base_sha256"] = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
        made["spans"] = [joined(x) for x in found]
        return made

    counts = ", ".join(f"n_{kind} bigint" for kind in BASE_KINDS)
    schema = f"`{id_col}` {type_of(docs, id_col)}, {counts}, base_sha256 string, spans string"
    return map_rows(scan_pii(docs, id_col, text_col), schema, kernel)
