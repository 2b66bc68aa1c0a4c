"""Secret scan: keyword prefilter, anchored expressions near its hits, embedded checksums.

One Aho-Corasick pass over the lower-cased text finds every keyword a secret can begin with;
an expression is tried only at such a place. Runs of hexadecimal digits have no keyword: every
run of 24 covers six places whose offset is a multiple of four, so one vector operation over
each fourth byte takes the keyword's part. Tokens that carry a checksum count only if it holds.

Kinds: ``assign``, ``access`` and ``hex`` (leftmost, not overlapping within a kind), then
``github`` and ``registry`` tokens whose last six characters are the base-62 CRC-32 of the body.

Defined results: a null text is an empty text; each row is scanned for itself, repeated ids
included; texts are scanned whole at any length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from lossledger.llm.common import map_rows

KINDS = ("assign", "access", "hex", "github", "registry")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CHECKED = {"github": re.compile(r"gh[opsur]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
            "registry": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "npm_": "registry",
    "gho_": "github", "ghp_": "github", "ghs_": "github", "ghu_": "github", "ghr_": "github",
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", "u1"))


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def _hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    """Byte ranges of the maximal runs of at least 24 hexadecimal digits."""
    probe = _IS_HEX[np.frombuffer(raw, "u1")[::4]]
    if len(probe) < 6:
        return
    near = probe[:-5] & probe[1:-4] & probe[2:-3] & probe[3:-2] & probe[4:-1] & probe[5:]
    last = 0
    for place in np.flatnonzero(near) * 4:
        if place < last:
            continue
        start = place
        while start > last and _IS_HEX[raw[start - 1]]:
            start -= 1
        last = start
        while last < len(raw) and _IS_HEX[raw[last]]:
            last += 1
        if last - start >= 24:
            yield int(start), int(last)


def scan(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in code points, by start and then by kind."""
    if not text:
        return []
    raw = text.encode()
    lower = raw.lower().decode()
    spans: list[tuple[str, int, int]] = []
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton.iter(lower))
    free = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            match = _ASSIGN.match(text, start)
            good = match and len(match[2]) >= 6
        elif kind == "access":
            match = _ACCESS.match(text, start)
            good = match and len(match[0]) >= 20
        else:
            match = _CHECKED[kind].match(text, start)
            good = match and checksum(match[1]) == match[2]
        if match:
            free[kind] = match.end()
            if good:
                spans.append((kind, start, match.end()))
    first = behind = 0
    for start, end in _hex_runs(raw):
        first += len(raw[behind:start].decode())
        behind = start
        spans.append(("hex", first, first + end - start))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def named(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: counts by kind, the digest of the base kinds, and every span."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        automaton = _automaton()
        for row in rows:
            spans = scan(row["text"], automaton)
            base = [s for s in spans if s[0] in KINDS[:3]]
            count = [sum(s[0] == kind for s in spans) for kind in KINDS]
            digest = hashlib.sha256(named(base).encode()).hexdigest()
            yield row["doc_id"], *count[:3], digest, named(spans), count[3] + count[4]

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(slim, {
        "doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
        "base_sha256": "string", "spans": "string", "n_checked": "bigint"}, run)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every stretch covered by a span replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets in the text replaced; the other columns and null texts stay as they are."""
    @pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        automaton = _automaton()
        return texts.map(lambda t: redact(t, scan(t, automaton)) if t else t)

    return docs.withColumn(text_col, clean(F.col(text_col)))
