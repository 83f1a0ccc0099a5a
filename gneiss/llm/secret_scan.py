"""Secret scanning: keywords first, anchored expressions near hits, then checksums.

One Aho-Corasick pass over the ASCII-lower-cased text finds every keyword; each kind's
expression is then tried only at the hits of its own keywords, anchored there, in text
order and past the end of the match before. As a match can start nowhere but at one of
its keywords, this gives the leftmost non-overlapping matches of a plain search. Hex runs
have no keyword; a byte-class map and a substring search stand in for it. Token formats
that embed a checksum (six base-62 digits of the CRC-32 of the token's body) are reported
only when it holds.

Defined results: null and empty texts have no spans; offsets are code points, end
exclusive; equal spans of different kinds are all reported, in the order of KINDS;
repeated rows are scanned each for itself; a null id stays null, ids are whole numbers; texts of any length are scanned
whole; an empty table gives an empty result. ``scan_documents`` reads no other columns, whatever their names;
``redact_documents`` carries all of them along, a null text staying null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import arrow, map_arrow, strings, with_ids

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[oprsu]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: keyword (ASCII lower case): kind whose expression starts there
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "gho_": "github", "ghp_": "github", "ghr_": "github",
    "ghs_": "github", "ghu_": "github", "npm_": "npm",
}
EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}

_HEX_CLASS = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x2E for b in range(256))
_HEX_RUN = b"x" * HEX_LEAST
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_automaton = None


def checksum62(body: str) -> str:
    """CRC-32 of the token's body as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits


def _automaton_of_keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


def _holds(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= ASSIGN_LEAST
    if kind == "access":
        return len(match[0]) >= ACCESS_LEAST
    return checksum62(match[0][4:-6]) == match[0][-6:]


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text by start, then kind as listed."""
    if not text:
        return []
    raw = text.encode()
    found = []
    past = dict.fromkeys(EXPRESSIONS, 0)
    lowered = raw.lower().decode()  # bytes.lower() changes A-Z alone, so code points keep their places
    for last, (size, kind) in _automaton_of_keywords().iter(lowered):
        start = last - size + 1
        if start < past[kind]:
            continue
        if match := EXPRESSIONS[kind].match(text, start):
            past[kind] = match.end()  # a failing match uses up its text too
            if _holds(kind, match):
                found.append((kind, start, match.end()))
    if _HEX_RUN in raw.translate(_HEX_CLASS):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[1], order[x[0]]))


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and ``spans``, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan(text)]
                for text in strings(batch, text_col)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"]
            )

    return map_arrow(
        with_ids(df, id_col), [id_col, text_col], run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every reported span, overlaps joined, replaced by ``mark``."""
    if text is None:
        return None
    out, at = [], 0
    for _, start, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in ``text_col``; ``count_col`` follows it."""
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(x) for x in batch.column(text_col).to_pylist()]
            columns = {n: batch.column(n) for n in names}
            columns[text_col] = pa.array(texts, batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    out = arrow(df, run, df.schema)
    if count_col in names:
        kind = df.schema[count_col].dataType
        out = out.withColumn(count_col, F.char_length(text_col).cast(kind))
    return out

