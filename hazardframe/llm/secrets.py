"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checksums.

An Aho-Corasick automaton finds the keywords; an expression is tried only where
a keyword starts, and only past the end of the last match of its kind, which
gives the same matches as a leftmost scan of the whole text. Hex runs have no
keyword and are scanned for directly. Token kinds that embed a checksum or a
readable header count only if it holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import map_rows, small_batches, spread, text_of, type_of

#: Kinds in the order that breaks ties of the start.
BASE_KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("github", "npm", "jwt", "private_key")
ORDER = {kind: i for i, kind in enumerate(BASE_KINDS + EXTRA_KINDS)}

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
KEY_BLOCK = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----")
#: Keyword (lower case) and the expression to try where it starts.
CUES = {
    "password": ("assign", ASSIGN),
    "passwd": ("assign", ASSIGN),
    "secret": ("assign", ASSIGN),
    "token": ("assign", ASSIGN),
    "apikey": ("assign", ASSIGN),
    "api_key": ("assign", ASSIGN),
    "akia": ("access", ACCESS),
    "ghp_": ("github", GITHUB),
    "gho_": ("github", GITHUB),
    "ghu_": ("github", GITHUB),
    "ghs_": ("github", GITHUB),
    "ghr_": ("github", GITHUB),
    "npm_": ("npm", NPM),
    "eyj": ("jwt", JWT),
    "-----begin ": ("private_key", KEY_BLOCK),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@cache
def _automaton():
    found = ahocorasick.Automaton()
    for cue, (kind, expression) in CUES.items():
        found.add_word(cue, (len(cue), kind, expression))
    found.make_automaton()
    return found


def ascii_lower(text: str) -> str:
    """Only A-Z change, so that code points keep their places."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def base62_crc32(body: str) -> str:
    """CRC-32 in six base-62 digits, as the checked token kinds embed it."""
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    if kind in ("github", "npm"):
        return base62_crc32(match[1]) == match[2]
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
        except ValueError:
            return False
        return isinstance(head, dict) and "alg" in head
    return True


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, in code points, by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    ends: dict[str, int] = {}
    found = _automaton().iter(ascii_lower(text))
    hits = sorted(((end - size + 1, kind, rx) for end, (size, kind, rx) in found), key=lambda h: h[0])
    for start, kind, expression in hits:
        if start >= ends.get(kind, 0) and (match := expression.match(text, start)):
            ends[kind] = match.end()
            if _holds(kind, match):
                spans.append((kind, start, match.end()))
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal covered run replaced by ``mark``."""
    out, at = [], 0
    runs: list[list[int]] = []
    for _, start, end in spans:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    for start, end in runs:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and its ``spans`` (kind, start, end).

    A null text counts as empty; an empty text has no spans; a null id stays
    null; repeated rows are each scanned, very long texts whole, and an empty
    table gives an empty one. Spans that tie in their start are ordered by kind.
    Further columns are never read, whatever their names.
    """

    def kernel(ids, texts):
        found = [find_secrets(x) for x in texts]
        return {
            id_col: ids,
            "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found],
        }

    schema = f"`{id_col}` {type_of(docs, id_col)}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(spread(docs.select(id_col, text_of(text_col).alias("text"))), schema, kernel)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in the texts replaced by a mark and the length renewed.

    Rows without secrets stay as they are, null texts included.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else redact(x, s) if (s := find_secrets(x)) else x)

    new = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        kind = type_of(docs, length_col)
        new = new.withColumn(
            length_col,
            F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)),
        )
    return new


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of what :func:`scan_secrets` finds, one row per document."""

    def kernel(ids, spans):
        found = [[(s["kind"], s["start"], s["end"]) for s in x] for x in spans]
        base = [[s for s in x if s[0] in BASE_KINDS] for x in found]
        count = lambda kind: [sum(s[0] == kind for s in x) for x in base]
        return {
            id_col: ids,
            "n_assign": count("assign"),
            "n_access": count("access"),
            "n_hex": count("hex"),
            "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base],
            "spans": [joined(x) for x in found],
        }

    schema = f"`{id_col}` {type_of(docs, id_col)}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_rows(scan_secrets(docs, id_col, text_col), schema, kernel)
