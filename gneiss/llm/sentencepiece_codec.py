"""Offset-preserving SentencePiece encoding and decoding.

The text is normalised by longest-prefix rules from the model's compiled character
map; the normaliser records, for every normalised byte, the byte of the source it
came from. Piece lengths then run over the normalised bytes and are projected
through that record, so each piece carries the byte span it covers in the source.
Segmentation itself is the sentencepiece library's.

Bytes that no rule changes stand for themselves in the record, those of a replacement all for
the first byte of what they replace. Spans of byte pieces are therefore single bytes of a
character that is as it was, and empty but for the last in one that was replaced. White space that
the model drops is in no span at the head and tail of a text, elsewhere in that of the piece before.

Defined results: null and empty texts give no ids and decode to the empty string, as do ids that
are null; a null doc_id stays null; repeated rows give repeated results; texts of any length are
encoded whole; an empty table gives an empty result; other columns of the input are not read,
whatever their names. The added prefix has an empty span at the start of the text. Should pieces
not cover the normalised bytes of a text, its spans are the library's own.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import map_arrow, slices, strings, with_ids

SPACE_PIECE = "▁".encode()
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6  # piece types of the model format


class CharacterMap:
    """The compiled map: a double-array trie from source prefixes to replacements.

    Layout: four bytes little-endian length of the trie, the trie as 32-bit units,
    then the replacements, each ended by a zero byte; a trie value is an offset there.
    """

    def __init__(self, blob: bytes):
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.replacements = blob[4 + size :]
        else:
            self.units, self.replacements = [], b""

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of source[at:] and what replaces it."""
        if not self.units:
            return None
        found = None
        node = self._offset(self.units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]

    def begins(self, byte: int) -> bool:
        """Whether a known prefix begins with this byte."""
        node = self._offset(self.units[0]) ^ byte if self.units else 0
        return bool(self.units) and node < len(self.units) and self.units[node] & 0x800000FF == byte

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Encoded(NamedTuple):
    ids: list[int]
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """One loaded model; made once in each Python worker."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        model = model_pb2.ModelProto()
        model.ParseFromString(data)
        rules = model.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.space = SPACE_PIECE if rules.escape_whitespaces else b" "
        self.as_suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.symbols = sorted(
            (p.piece.encode() for p in model.pieces if p.type == USER_DEFINED), key=len, reverse=True
        )
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == UNKNOWN}
        #: Bytes of each piece in the normalised text.
        self.length = np.array(
            [1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64
        )
        self.begins = np.zeros(256, bool)  # bytes that a rule or symbol may begin with
        for byte in range(256):
            self.begins[byte] = self.map.begins(byte) or any(s[0] == byte for s in self.symbols)
        self.digits = [str(i) for i in range(len(model.pieces))]

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            with open(path, "rb") as file:
                cls._loaded[path] = cls(file.read())
        return cls._loaded[path]

    def _matches(self, source: bytes, bytes_: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(at, width, replacement) of every symbol and every prefix that a rule replaces, in order."""
        done = 0
        for at in np.flatnonzero(self.begins[bytes_]).tolist():
            if at < done or source[at] & 0xC0 == 0x80:  # inside of what was read already
                continue
            symbol = next((s for s in self.symbols if source.startswith(s, at)), None)
            found = (len(symbol), symbol) if symbol else self.map.longest(source, at)
            if found:
                done = at + found[0]
                yield at, *found

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte it stands at."""
        source = text.encode()
        raw = np.frombuffer(source, np.uint8)
        origin = np.arange(len(raw))
        # Where the piece that a byte stands in begins: a character, or all that replaces a prefix.
        piece = origin
        if self.begins.any() and (found := list(self._matches(source, raw))):
            parts, at = [], 0
            for start, width, new in found:
                parts.append((raw[at:start], np.arange(at, start), np.arange(at, start)))
                same = new == source[start : start + width]
                parts.append((
                    np.frombuffer(new, np.uint8), np.arange(start, start + width) if same else np.full(len(new), start), np.full(len(new), start)
                ))
                at = start + width
            parts.append((raw[at:], np.arange(at, len(raw)), np.arange(at, len(raw))))
            raw, origin, piece = (np.concatenate(c) for c in zip(*parts, strict=True))
        if self.squeeze and len(raw):
            space = raw == 32
            first = np.searchsorted(piece, piece)  # place of the piece's first byte
            after_space = (first == 0) | space[first - 1]
            others = np.concatenate(([0], np.cumsum(~space)))
            leading = space & (others[np.arange(len(raw))] == others[first])
            raw, origin = raw[~(leading & after_space)], origin[~(leading & after_space)]
        end = len(source)
        if not len(raw):
            return b"", np.array([end], np.int64)
        mark = len(self.space)
        out = raw.tobytes().replace(b" ", self.space)
        origin = np.repeat(origin, np.where(raw == 32, mark, 1))
        if self.prefix and not self.as_suffix:
            out, origin = self.space + out, np.concatenate((np.full(mark, origin[0] if self.squeeze else 0), origin))
        if self.squeeze:
            size = len(out)
            while out.endswith(self.space, 0, size):  # a literal mark at the end is a space too
                size -= mark
                end = int(origin[size])
            out, origin = out[:size], origin[:size]
        if self.prefix and self.as_suffix:
            out, origin = out + self.space, np.concatenate((origin, np.full(mark, end)))
        return out, np.append(origin, end)

    def encode(self, texts: list[str]) -> list[Encoded]:
        return [
            self._project(text, ids)
            for text, ids in zip(texts, self.processor.encode(texts, num_threads=1), strict=True)
        ]

    def _project(self, text: str, ids: list[int]) -> Encoded:
        if not ids:
            none = np.zeros(0, np.int64)
            return Encoded(ids, none, none)
        normal, origin = self.normalise(text)
        lengths = self.length[np.array(ids, np.int64)]
        if self.unknown.intersection(ids):  # an unknown piece has no length of its own
            lengths = np.array([len(p.piece.encode()) for p in self.processor.encode(text, return_type="proto").pieces], np.int64)
        stops = np.cumsum(lengths)
        if stops[-1] != len(normal):
            return Encoded(ids, *self.library_spans(text))
        return Encoded(ids, origin[stops - lengths], origin[stops])

    def library_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The library's own byte spans; those of byte pieces but the last of a character are empty."""
        from sentencepiece import sentencepiece_pb2

        proto = sentencepiece_pb2.SentencePieceText()
        proto.ParseFromString(self.processor.encode(text, return_type="serialized_proto"))
        return np.array([p.begin for p in proto.pieces], np.int64), np.array([p.end for p in proto.pieces], np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids) if ids else []


Finish = Callable[[Codec, pa.RecordBatch, list[str], list[Encoded]], pa.RecordBatch]


def encoded(df: DataFrame, id_col: str, text_col: str, model: str, schema: str, finish: Finish) -> DataFrame:
    """Encode every text and let ``finish`` make the output rows of each slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model)
        for batch in batches:
            texts = strings(batch, text_col)
            for a, b in slices(texts):
                yield finish(codec, batch.slice(a, b - a), texts[a:b], codec.encode(texts[a:b]))

    return map_arrow(with_ids(df, id_col), [id_col, text_col], run, schema)


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, token ids, and the byte span of each piece in the source."""

    def finish(codec, batch, texts, rows):
        return pa.RecordBatch.from_arrays(
            [
                batch.column(id_col).cast(pa.int64()),
                pa.array([r.ids for r in rows], pa.list_(pa.int32())),
                pa.array([r.starts for r in rows], pa.list_(pa.int64())),
                pa.array([r.ends for r in rows], pa.list_(pa.int64())),
            ],
            ["doc_id", "ids", "starts", "ends"],
        )

    return encoded(
        df, id_col, text_col, model,
        "doc_id long, ids array<int>, starts array<long>, ends array<long>", finish,
    )


def decode_documents(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and the decoded text; null ids decode to the empty string."""

    def run(batches):
        codec = Codec.load(model)
        for batch in batches:
            ids = [x or [] for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(codec.decode(ids), pa.string())],
                ["doc_id", "text"],
            )

    return map_arrow(with_ids(df, id_col), [id_col, ids_col], run, "doc_id long, text string")
