"""Hierarchical multi-length packing.

A document's tokens and its end id are cut into whole windows of the longest tier;
what remains is routed to the smallest tier that holds it. Tiers are packed from long
to short: a window opens with the longest fragment of its tier, the gap is filled with
the longest fitting fragments of the same or shorter tiers, and when none fits, a
shorter fragment is cut to the gap. Every window of a tier is thus full, and as tiers
are powers of two none is padded; only the last few tokens of a task are left as one
short sequence.

Packing is local to a task: it moves no rows, and a lost task makes the same sequences
again. Sequence ids hold the partition in their upper bits. Step groups are balanced over all
tasks: once the pieces are written, the sequences of a tier are numbered through, from the counts of
the tasks alone, and every group of a tier but its last has ``step_tokens`` tokens (where the tier's
sequences are whole).

Defined results: a null or empty text has the end id alone; a null doc_id is carried
as null; repeated rows are packed each for itself; texts of any length are cut into as many windows as
they take; an empty table gives an empty result; other columns may have any names and are not read.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import durable, give_back, map_arrow, tidy
from gneiss.llm.common import with_ids as check_ids

TIERS = (2048, 1024, 512, 256, 128, 64)
STEP_TOKENS = 65_536


# The settings of a tokenizer file whose words may be tokenized one by one.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: How the tokenizer splits a normalised text, and words in which that is plain: printable ASCII and Latin letters.
_SPLIT = regex.compile(_PATTERN)
_PLAIN = regex.compile(r"[!-~\u00a1-\u00ac\u00ae-\u024f]+")
_WHITE = regex.compile(r"\s")
_COMBINING = 0xCC  # first byte of U+0300 in UTF-8; before any lower one, normalisation form C leaves a letter as it is
#: Words of one text for the model, texts of one call of the library, texts whose ids are put together at once, and bytes of texts cut at once.
LINE, CALL, ROWS, SLICE = 500, 20, 200, 2_000_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for U+0100 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


_LETTERS = _byte_letters()
#: Code points of the byte-level alphabet by byte; separators stay what they are.
_POINTS = np.array([_LETTERS[b] if b not in b" \n" else chr(b) for b in range(256)]).view(np.uint32)
#: Words of letters below U+0250 alone, whose lower case is one letter each.
_WORD = "^[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1) + "]+$"
_SUFFIX = "</w>"  # of a word's last piece


def _starts() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes, and by six times one byte's kind and the next one's: whether a word starts at the next one.

    Words start behind white space, and where the pattern ends one piece and starts another whatever stands around: at a change among
    ASCII letters, digits and marks and at each digit, but not behind an apostrophe, which may open a contraction.
    """
    white, letter, digit, mark, apostrophe, other = range(6)
    kind = np.full(256, other, np.uint8)
    kind[33:127] = mark
    kind[list(b" \t\n\v\f\r")] = white
    kind[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = letter
    kind[list(b"0123456789")] = digit
    kind[ord("'")] = apostrophe
    starts = np.zeros((6, 6), bool)
    starts[white, 1:] = True
    starts[letter, [digit, mark, apostrophe]] = True
    starts[digit, [letter, digit, mark, apostrophe]] = True
    starts[mark, [letter, digit]] = starts[apostrophe, digit] = True
    return kind, starts.ravel()


_KIND, _STARTS = _starts()


def _cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts (none null), and the number of words before each text's end, from 0.

    Words that differ in the case of ASCII letters alone are one word, as the tokenizer lower-cases them anyway; but it does so
    after composition, and not every letter that composes in lower case does so in upper case.
    """
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = _KIND[data]
    starts = np.ones(len(data), bool)
    starts[1:] = _STARTS[6 * kind[:-1] + kind[1:]]
    starts[at[:-1][at[:-1] < len(data)]] = True
    shown = kind != 0
    starts &= shown
    before = np.searchsorted(np.flatnonzero(starts), at)
    upper = (data - np.uint8(65)) < 26
    upper[:-1] &= data[1:] < _COMBINING
    data = data + (upper.view(np.uint8) << np.uint8(5))
    data, begins = data[shown], np.flatnonzero(starts[shown]).astype(np.int32)
    begins = np.append(begins, np.int32(len(data)))
    return pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data)), before


def _put(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` behind its first ``used`` entries, in a larger one if it is full."""
    if used + len(more) > len(array):
        array = np.concatenate((array[:used], np.zeros(used + 2 * len(more), array.dtype)))
    array[used : used + len(more)] = more
    return array


def _encoded(tokenizer, texts: list[str], some: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, ``some`` of them at a time, and the number of each."""
    found = [np.zeros(0, np.uint32)]
    for at in range(0, len(texts), some):
        found += [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts[at : at + some], add_special_tokens=False)]
    return np.concatenate(found), np.array([len(x) for x in found[1:]], np.int32)


class WordTokenizer:
    """Ids of whole texts by a tokenizer, whose pieces never cross ASCII white space if its file has the settings above.

    A file with other settings goes through the library text by text. Else the texts of a batch are cut at ASCII white space and between
    ASCII letters, digits and marks, each distinct word is tokenized once, and its ids are kept. The tokenizer's normaliser and splitter drop
    white space and look at no neighbour across a cut, so the ids are those of the whole text. Words of printable ASCII and Latin letters
    are lower-cased and split here, and many at a time go to the library's model, which takes them as it would its own; their ids part at the
    suffix of last pieces. Any other word, and the words of a text with a special token, go through the whole library. At most ``most_words``
    are kept, unless one batch has more; then, and with each task, the store starts anew.
    """

    _loaded: dict[tuple[str, int], WordTokenizer] = {}

    def __init__(self, path: str, most_words: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most_words = Tokenizer.from_file(path), most_words
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        added, model = self.tokenizer.get_added_tokens_decoder().values(), settings["model"]
        self.by_word = (
            settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _SPLITTER and model["type"] == "BPE"
            and not model["dropout"] and not settings["truncation"] and not settings["padding"]
            and model["end_of_word_suffix"] == _SUFFIX and not model["continuing_subword_prefix"]
            and all(c + end in model["vocab"] for c in _LETTERS.values() for end in ("", _SUFFIX))
            and all(t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) and t.content.islower() and not _WHITE.search(t.content) for t in added)
        )
        self.special = [t.content for t in added]
        if self.by_word:
            self.parts = Tokenizer(self.tokenizer.model)
            self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.last[[i for piece, i in model["vocab"].items() if piece.endswith(_SUFFIX)]] = True
        self.clear()

    @classmethod
    def load(cls, path: str, most_words: int = 200_000) -> WordTokenizer:
        key = path, most_words
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, most_words)
        return cls._loaded[key]

    def clear(self) -> None:
        self.kept = pa.array([], pa.string())
        self.start, self.count = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    @property
    def known(self) -> list[str]:
        """The words that are kept; a task holds them in Arrow alone, as a dict of strings takes ten times the memory."""
        return self.kept.to_pylist()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts by the whole library, and the number of each."""
        return _encoded(self.tokenizer, texts, LINE)

    def _model(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of the splitter, in lower case with spaces or line ends between, by the model, and the number of each."""
        raw = np.frombuffer(lines.encode(), np.uint8)
        letters = _POINTS[raw].tobytes().decode("utf-32-le" if sys.byteorder == "little" else "utf-32-be")
        flat, _ = _encoded(self.parts, letters.split("\n"), CALL)
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1).astype(np.int32)

    def _learn(self, words: pa.StringArray) -> None:
        """Keep the ids of distinct new words."""
        simple = pc.match_substring_regex(words, _WORD).to_numpy(zero_copy_only=False)
        own = words.filter(pa.array(simple))
        found, pieces, rest = [], {}, []
        n = len(self.kept)
        if len(own):
            lines = pa.ListArray.from_arrays(pa.array([*range(0, len(own), LINE), len(own)], pa.int32()), own)
            found.append(self._model("\n".join(pc.binary_join(lines, " ").to_pylist()).lower()))
        for word in words.filter(pa.array(~simple)).to_pylist():
            low = word.lower()
            if _PLAIN.fullmatch(word) and low.isprintable() and not any(s in word for s in self.special):
                pieces[word] = _SPLIT.findall(low)
            else:
                rest.append(word)
        if pieces:
            ids, counts = self._model("\n".join(map(" ".join, pieces.values())))
            first = np.cumsum([0, *map(len, pieces.values())])[:-1]
            found.append((ids, np.add.reduceat(counts, first, dtype=np.int32)))
        if rest:
            found.append(self._library(rest))
        ids, counts = map(np.concatenate, zip(*found, strict=True))
        self.kept = pa.concat_arrays([self.kept, own, pa.array([*pieces, *rest], pa.string())])
        self.start = _put(self.start, n, self.used + np.cumsum(counts) - counts)
        self.count = _put(self.count, n, counts)
        self.pool = _put(self.pool, self.used, ids)
        self.used += len(ids)

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of the words that are kept; -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.kept), -1).to_numpy(zero_copy_only=False).copy()

    def _numbers(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of distinct words, those not yet kept being learnt."""
        numbers = self._places(words)
        new = numbers < 0
        if len(self.kept) and (len(self.kept) + new.sum() > self.most_words or self.used > 50 * self.most_words):
            self.clear()
            new[:] = True
        if new.any():
            some = words.filter(pa.array(new))
            self._learn(some)
            numbers[new] = self._places(some)
        return numbers

    def _by_word(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        words, before = _cut(texts)
        words = words.dictionary_encode()
        place = self._numbers(words.dictionary)[words.indices.to_numpy()]
        del words
        for begin in range(0, len(texts), ROWS):
            ends = before[begin : begin + ROWS + 1]
            here = place[ends[0] : ends[-1]]
            counts = self.count[here]
            to = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))
            at = np.repeat(self.start[here] - to[:-1], counts)
            at += np.arange(len(at))
            yield from np.split(self.pool[at], to[ends[1:-1] - ends[0]])

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            yield from (np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, np.uint32) for t in texts)
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            end = int(np.searchsorted(ends, ends[begin] + SLICE, "right"))
            yield from self._some(texts.slice(begin, end - begin))
            begin = end

    def _some(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        # Special tokens are of lower case, and the tokenizer looks for them before it lower-cases; so texts that hold one in any case go another way.
        lower, special = pc.ascii_lower(texts), np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(lower, s).to_numpy(zero_copy_only=False)
        del lower
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        for i, ids in enumerate(self._by_word(plain)):
            if special[i]:
                words = texts[i].as_py().encode().split()  # bytes.split() knows the six ASCII white space characters
                ids = self._library([w.decode() for w in words])[0]
            yield ids

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))


class _Fragments:
    """Fragments (document, start, length) by length; the longest that fits is found by bits."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.bits, self.tokens = 0, 0

    def add(self, document: int, start: int, length: int) -> None:
        if length:
            self.by_length.setdefault(length, []).append((document, start))
            self.bits |= 1 << length
            self.tokens += length

    def longest(self, most: int) -> int:
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def shortest(self, least: int) -> int:
        above = self.bits >> least
        return least + (above & -above).bit_length() - 1 if above else -1

    def take(self, length: int) -> tuple[int, int, int]:
        rows = self.by_length[length]
        document, start = rows.pop()
        if not rows:
            self.bits &= ~(1 << length)
        self.tokens -= length
        return document, start, length


def pack(lengths: list[int], tiers: tuple[int, ...], pool: _Fragments | None = None, first: int = 0, last: bool = True):
    """Windows over documents ``first``, ``first + 1``, ... of these lengths.

    Yields (window size, [(document, start, length), ...]); fragments that do not yet
    fill a window of the longest tier stay in ``pool`` unless this is the last call.
    """
    pool = pool if pool is not None else _Fragments()
    top, low = tiers[0], tiers[-1]
    for document, length in enumerate(lengths, first):
        whole = length // top * top
        for start in range(0, whole, top):
            yield top, [(document, start, top)]
        pool.add(document, whole, length - whole)
    while pool.tokens >= (low if last else 2 * top):
        longest = pool.longest(top)
        # The tier of the longest fragment, or a shorter one if all that is left cannot fill it.
        size = next(t for t in reversed(tiers) if t >= min(longest, top))
        while size > pool.tokens:
            size //= 2
        window, gap = [], size
        while gap:
            length = pool.longest(gap)
            if length > 0:
                window.append(pool.take(length))
                gap -= length
            else:
                document, start, length = pool.take(pool.shortest(gap + 1))
                window.append((document, start, gap))
                pool.add(document, start + gap, length - gap)
                gap = 0
        yield size, window
    if last and pool.tokens:
        rest = []
        while (length := pool.longest(top)) > 0:
            rest.append(pool.take(length))
        yield sum(x[2] for x in rest), rest


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_group long"
)


@tidy
def pack_documents(
    df: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 1,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document in a sequence; ``with_ids`` adds the piece's ids.

    ``tier`` is the context size of the window (a sequence is padded to the longest tier
    only where its length is no power of two), ``step_group`` its group of equal tokens, tiers apart.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers are powers of two, longest first")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.load(tokenizer)
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        pool, held, seen, sequences, of_tier = _Fragments(), {}, 0, 0, dict.fromkeys(tiers, 0)
        rows: list[tuple] = []

        def place(windows):
            nonlocal sequences
            for size, window in windows:
                tier = next(t for t in reversed(tiers) if t >= size)
                number = of_tier[tier]
                of_tier[tier] += 1
                offset = 0
                for document, start, length in window:
                    doc_id, ids = held[document]
                    piece = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(piece), len(ids), part + sequences, offset, tier, number, *([piece] if with_ids else [])))
                    offset += length
                sequences += 1

        def out():
            columns = list(zip(*rows, strict=True)) or [()] * (9 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            doc_ids = batch.column(id_col).to_pylist()
            lengths, size = [], 0
            for i, (doc_id, ids) in enumerate(zip(doc_ids, words.encode_all(batch.column(text_col)), strict=True)):
                ids = np.concatenate((ids, np.array([end_id], np.uint32))).astype("<u4", copy=False)
                held[seen + len(lengths)] = doc_id, ids
                lengths.append(len(ids))
                size += len(ids)
                if size >= 4_000_000 or i == len(doc_ids) - 1:
                    place(pack(lengths, tiers, pool, seen, last=False))
                    seen, lengths, size = seen + len(lengths), [], 0
                    open_ = {d for x in pool.by_length.values() for d, _ in x}
                    held = {d: held[d] for d in open_}
                    give_back()
                    yield out()
        place(pack([], tiers, pool, seen, last=True))
        words.clear()
        if rows:
            yield out()

    schema = PIECES.replace("step_group", "number") + (", ids array<int>" if with_ids else "")
    pieces = durable(map_arrow(check_ids(df, id_col), [id_col, text_col], run, schema))
    part = F.shiftright("sequence_id", 36).alias("part")
    counts = durable(pieces.where("offset = 0").groupBy(part, "tier").agg(F.count(F.lit(1)).alias("sequences")))
    earlier = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("part").alias("base_part"), F.col("tier").alias("base_tier"), F.coalesce(F.sum("sequences").over(earlier), F.lit(0)).alias("base"))
    of_task = (F.shiftright("sequence_id", 36) == F.col("base_part")) & (F.col("tier") == F.col("base_tier"))
    index = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")) - 1
    sequences = F.greatest(F.lit(step_tokens) / F.col("tier"), F.lit(1)).cast("long")
    group = F.shiftleft(index.cast("long"), 58) + F.floor((F.col("base") + F.col("number")) / sequences)
    return pieces.join(durable(base), of_task).select(
        *(group.cast("long").alias("step_group") if n == "number" else n for n in pieces.columns)
    )
