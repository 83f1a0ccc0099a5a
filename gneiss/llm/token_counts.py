"""Token counts of texts by whole-token shortcut.

A merge of a SentencePiece BPE model can only make a piece of its vocabulary. So no merge passes a
place where no piece could stand across: before a space mark that follows another character, where no piece has a mark
inside, and on either side of a character that is in no piece of several characters. These places cut the text
into pre-tokens that are merged each for itself, and a text has as many tokens as they have together.

Of every vocabulary string that is a pre-token it is proved beforehand, by the library itself, whether it encodes alone as
one token. Pre-tokens among those are counted as one each, by look-up; only the rest are merged, by the library, and a
worker remembers the counts of short ones. Models that do not allow the cuts (a character map, squeezed spaces,
symbols of the user's, another kind of model or file) are counted whole by their library.

Defined results: null and empty texts have no bytes and no tokens; a null doc_id stays null; repeated rows give
repeated results; texts and words of any length are counted whole; an empty table gives an empty result; other columns of
the input are not read, whatever their names; there are no ties.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import map_arrow, slices, strings, with_ids

MARK = "▁"
NORMAL, CONTROL, UNKNOWN, BYTE, BPE = 1, 3, 2, 6, 2  # kinds of pieces and of models in the model format
#: Rest words that a worker remembers, and the longest one worth it.
MEMORY, MEMORABLE = 300_000, 64
#: Characters whose words are looked up together, where no text is longer, and words of one call of the library.
SLICE, WORDS = 500_000, 200


class Counter:
    """Counts by a library alone."""

    _loaded: dict[str, Counter] = {}

    @classmethod
    def load(cls, path: str) -> Counter:
        """The counter of a tokenizer's file, made once in each worker."""
        if path not in cls._loaded:
            cls._loaded[path] = _json_counter(path) if path.endswith(".json") else _model_counter(path)
        return cls._loaded[path]

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens that look-up counted) of each text."""
        return [(len(self.encode(text)) if text else 0, 0) for text in texts]


class ShortcutCounter(Counter):
    def __init__(self, encode, joined: set[str], anchor: str, pieces: list[str]):
        inner = "[" + "".join(map(re.escape, sorted(joined - {MARK, " "}))) + "]"
        self.words = re.compile(f" *{inner}+| +|[^ ]")
        # Behind a character that nothing joins a word is merged as it is in a text. That character is one token, and no
        # other text has this token, so one call tells the counts of many words.
        self.encode, self.anchor, self.anchor_id = encode, anchor, encode(anchor)[-1]
        candidates = [word for p in pieces if self.words.fullmatch(word := p.replace(MARK, " ")) and word != anchor]
        self.whole = frozenset([w for w, n in self._lengths(candidates).items() if n == 1] + [anchor])
        self.memory: dict[str, int] = {}

    def _alone(self, words: list[str]) -> list[int]:
        ids = np.array(self.encode(self.anchor + self.anchor.join(words)), np.int64)
        return (np.diff(np.flatnonzero(ids == self.anchor_id), append=len(ids)) - 1).tolist()

    def _lengths(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word, by calls of a bounded number of words."""
        parts = (words[at : at + WORDS] for at in range(0, len(words), WORDS))
        return {word: n for part in parts for word, n in zip(part, self._alone(part), strict=True)}

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        words = [self.words.findall(" " + text.replace(MARK, " ")) if text else [] for text in texts]
        rest = [[word for word in own if word not in self.whole] for own in words]
        known = self.memory
        new = set(chain.from_iterable(rest)).difference(known)
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = set(chain.from_iterable(rest))
        known.update(self._lengths(list(new)))
        out = [(len(w) - len(r) + sum(map(known.__getitem__, r)), len(w) - len(r)) for w, r in zip(words, rest, strict=True)]
        for word in new:
            if len(word) > MEMORABLE:
                del known[word]
        return out


def _model_counter(path: str) -> Counter:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    with open(path, "rb") as file:
        data = file.read()
    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = model_pb2.ModelProto()
    model.ParseFromString(data)
    rules, pieces = model.normalizer_spec, [p.piece for p in model.pieces if p.type == NORMAL]

    joined = {c for p in pieces if len(p) > 1 for c in p} | {MARK}
    anchor = next((c for c in "\n\t\v" if c not in joined and len(processor.encode(c)) == 2), None)
    cuts = (
        model.trainer_spec.model_type == BPE and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
        and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        and {p.type for p in model.pieces} <= {NORMAL, CONTROL, UNKNOWN, BYTE} and not any(MARK in p.lstrip(MARK) for p in pieces)
    )
    return ShortcutCounter(processor.encode, joined, anchor, pieces) if cuts and anchor else Counter(processor.encode)


def _json_counter(path: str) -> Counter:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return Counter(lambda text: tokenizer.encode(text, add_special_tokens=False).ids)


def count_tokens(df: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``) and n_whole, the
    pre-tokens that look-up counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(model)
        for batch in batches:
            texts = strings(batch, text_col)
            found = [n for begin, end in slices(texts, SLICE) for n in counter.counts(texts[begin:end])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).cast(pa.int64()),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([n > limit for n, _ in found], pa.bool_()),
                    pa.array([n for _, n in found], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"],
            )

    return map_arrow(with_ids(df, id_col), [id_col, text_col], run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
