"""Substring deduplication by hashing lines and paragraphs of lines.

A text is cut into lines and lines into sentences: after . ! ? before white space, and after a full
stop of a script without spaces. The units that are hashed are paragraphs: of each line, the shortest
stretches of whole sentences with ``least_words`` words, one from every sentence onwards and one up to
every sentence. A whole line is made of its paragraphs, so a repeated line goes whole, and so does a
passage of whole sentences inside of other lines, which no hash of whole lines would find. Lines
under ``least_words`` words are not units: they are headings and notices that many unrelated documents
hold, and line deduplication's business.

Units are normalised (ASCII lower case, white space as one space) and hashed to 128 bits; digests
are grouped over all documents. The earliest place of a unit, by doc_id and position, keeps it;
sentences in any unit whose earliest place is another are removed, as spans of the original text in
code points. A place in the same document counts as another from the end of the first one on.

Pass one groups digests, pre-aggregated before the shuffle. Pass two sends the digests that may be
repeated (a filter over those digests tells, at most bloom.MOST_BITS) to be confirmed by an exact
join whose large keys Spark splits. Texts move only for documents that lose a unit to an earlier
one; a document that repeats only itself is cut where it lies.

Defined results: a null or empty text has no units, nor has one under ``least_words`` words; a line
without sentence ends is one sentence, of any length; a character of a script without spaces is a word.
Rows that repeat a doc_id are one document, but each is searched for its own repeats; equal rows give
one row a span. A row without doc_id neither keeps nor loses a unit. An empty table gives an empty
result; other columns may have any names and are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import bloom
from gneiss.llm.common import WHITE, WHITE_CLASS, arrow, durable, map_arrow, strings, tidy, with_ids

LEAST_WORDS = 20
_END = re.compile(rf"[.!?]+(?={WHITE_CLASS})|[。！？]+")
#: Characters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
DENSE = "\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u3000-\u9fff\uff00-\uff7f\U00020000-\U0003ffff"
_DENSE = re.compile(f"[{DENSE}]")
_WORD = re.compile(f"[{DENSE}]|[^ {DENSE}]+")


class Unit(NamedTuple):
    first: int  # sentence
    last: int
    digest: bytes


class Sentences(NamedTuple):
    """The sentences of a text in order, and its units by line."""

    starts: list[int]
    ends: list[int]
    words: list[int]
    lines: list[int]
    units: list[Unit]


def paragraphs(words: list[int], least_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest stretches of sentences with ``least_words`` words from and up to each sentence."""
    found = set()
    last, held = -1, 0
    for first, n in enumerate(words):
        while held < least_words and last + 1 < len(words):
            last += 1
            held += words[last]
        if held < least_words:
            break
        found.add((first, last))
        held -= n
    first, held = len(words), 0
    for last in range(len(words) - 1, -1, -1):
        while held < least_words and first:
            first -= 1
            held += words[first]
        if held < least_words:
            break
        found.add((first, last))
        held -= words[last]
    return sorted(found)


def sentences(text: str, least_words: int) -> Sentences:
    out = Sentences([], [], [], [], [])
    dense = not text.isascii() and _DENSE.search(text) is not None
    at = 0
    for number, line in enumerate(text.split("\n")):
        begin, forms, cut = len(out.starts), [], 0
        for stop in (*(m.end() for m in _END.finditer(line)), len(line)):
            piece = line[cut:stop]
            body = piece.strip(WHITE)
            if body:
                form = b" ".join(body.encode().lower().split())
                start = at + cut + len(piece) - len(piece.lstrip(WHITE))
                out.starts.append(start)
                out.ends.append(start + len(body))
                out.words.append(len(_WORD.findall(form.decode())) if dense else form.count(b" ") + 1)
                out.lines.append(number)
                forms.append(form)
            cut = stop
        own = out.words[begin:]
        if sum(own) >= least_words:
            whole = b" ".join(forms)
            edges = np.cumsum([0, *(len(f) + 1 for f in forms)]).tolist()
            for a, b in paragraphs(own, least_words):
                digest = hashlib.blake2b(whole[edges[a] : edges[b + 1] - 1], digest_size=16).digest()
                out.units.append(Unit(begin + a, begin + b, digest))
        at += len(line) + 1
    return out


def spans(found: Sentences, keepers: dict[bytes, int], own: int) -> list[tuple[int, int, int, int]]:
    """(start, end, words, keeper) of what goes: stretches of sentences, by line, in units that ``keepers`` names with
    an earlier document, or whose first place in this document, ``own``, ends before."""
    keeper: dict[int, int] = {}
    until: dict[bytes, int] = {}
    for unit in found.units:
        by = keepers.get(unit.digest)
        if by is None:
            if unit.first <= until.setdefault(unit.digest, unit.last):
                continue
            by = own
        for i in range(unit.first, unit.last + 1):
            keeper[i] = min(by, keeper.get(i, by))
    out: list[tuple[int, int, int, int]] = []
    stretch: list[int] = []
    for i in sorted(keeper):
        if stretch and (i != stretch[-1] + 1 or found.lines[i] != found.lines[stretch[-1]]):
            out.append(_span(found, stretch, keeper))
            stretch = []
        stretch.append(i)
    return out + [_span(found, stretch, keeper)] if stretch else out


def _span(found: Sentences, stretch: list[int], keeper: dict[int, int]) -> tuple[int, int, int, int]:
    return found.starts[stretch[0]], found.ends[stretch[-1]], sum(found.words[i] for i in stretch), min(keeper[i] for i in stretch)


def _first_eight(digests: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8")


@tidy
def repeated_passages(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each removed passage: doc_id, span_start, span_end, n_words, keep_id, passage."""
    context = with_ids(df, id_col).sparkSession.sparkContext

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(id_col).to_pylist(), strings(batch, text_col), strict=True):
                if doc_id is not None:
                    own = {u.digest for u in sentences(text, least_words).units}
                    ids += [doc_id] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "digest"])

    pairs = map_arrow(df, [id_col, text_col], digests, "doc_id long, digest binary")
    grouped = pairs.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
    repeated = durable(grouped.where("keeper <> last").select("digest", "keeper"))
    bits = bloom.filter_bits(repeated.count())
    known = context.broadcast(
        bloom.repeated_filter(repeated, ["digest"], lambda b: _first_eight(b.column(0).to_pylist()), bits, least=1)
    )  # at most bloom.MOST_BITS

    def suspect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(id_col).to_pylist(), strings(batch, text_col), strict=True):
                units = sentences(text, least_words).units if doc_id is not None else []
                own = list({u.digest for u in units})
                hit = bloom.contains(known.value, _first_eight(own)).tolist() if own else []
                if len(own) < len(units) or any(hit):
                    rows.append((doc_id, len(own) < len(units), [d for d, h in zip(own, hit, strict=True) if h]))
            kinds = (pa.int64(), pa.bool_(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "again", "digests"])

    rows = durable(map_arrow(df, [id_col, text_col], suspect, "doc_id long, again boolean, digests array<binary>"))
    exact = rows.select("doc_id", F.explode("digests").alias("digest")).join(repeated.hint("merge"), "digest")
    lost = exact.where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set(F.struct("digest", "keeper")).alias("lost"))
    lost = durable(lost)
    losing, again = bloom.id_filter(lost, "doc_id"), bloom.id_filter(rows.where("again"), "doc_id")

    def cut(ids: list, texts: list[str], keepers: Iterable[dict[bytes, int]]) -> pa.RecordBatch:
        out = []
        for doc_id, text, named in zip(ids, texts, keepers, strict=True):
            found = sentences(text, least_words)
            out += [(doc_id, a, b, n, keeper, text[a:b]) for a, b, n, keeper in spans(found, named, doc_id)]
        kinds = [pa.int64()] * 5 + [pa.string()]
        names = ["doc_id", "span_start", "span_end", "n_words", "keep_id", "passage"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names)

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = bloom.id_hashes(batch.column(id_col))
            here = pc.and_(pc.is_valid(batch.column(id_col)), pa.array(bloom.contains(again.value, ids) & ~bloom.contains(losing.value, ids)))
            batch = batch.filter(here)
            texts = strings(batch, text_col)
            yield cut(batch.column(id_col).to_pylist(), texts, ({} for _ in texts))

    def may_lose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = pc.and_(pc.is_valid(batch.column(id_col)), pa.array(bloom.contains(losing.value, bloom.id_hashes(batch.column(id_col)))))
            batch = batch.filter(here)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), batch.column(text_col)], ["doc_id", "text"])

    def to_others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Flat columns: a list of structs would come as a dictionary for each digest.
            lost = batch.column("lost")
            digests, keepers = (c.to_pylist() for c in lost.flatten().flatten())
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lost), 0).to_numpy()).tolist()
            named = (dict(zip(digests[a:b], keepers[a:b], strict=True)) for a, b in zip([0, *ends], ends, strict=False))
            yield cut(batch.column("doc_id").to_pylist(), strings(batch, "text"), named)

    schema = "doc_id long, span_start long, span_end long, n_words long, keep_id long, passage string"
    held = map_arrow(df, [id_col, text_col], may_lose, "doc_id long, text string").join(lost.hint("merge"), "doc_id", "left")
    found = map_arrow(df, [id_col, text_col], alone, schema).unionByName(arrow(held, to_others, schema))
    return found.dropDuplicates(["doc_id", "span_start", "span_end", "passage"])
