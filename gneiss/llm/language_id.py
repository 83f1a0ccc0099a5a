"""Language identification by error-correcting output codes.

Each learned language has a codeword of +1 and -1; per bit of the code, a binary
classifier over hashed byte 3-grams and 4-grams of the lower-cased letters tells on which side
a text lies. A text's value for a bit is the classifier's mean log-odds per n-gram over the
whole text. Decoding takes the codeword with the least summed logistic loss, each bit
weighted by how well its classifier does on the training rows; a small gap to the second
codeword marks the text as ambiguous.

That tells languages apart, not whether a text is in any of them. Its fit does: the mean
log-likelihood of its n-grams under the even mixture of the learned languages. The mixture is
learned from one half of the sample, and the other half sets how far below the usual fit of a
language a text may lie; the fewer n-grams it has, the further.

Training reads a bounded sample: about ``PER_LANGUAGE`` documents of each language, chosen by
a hash of the id, whose n-gram counts (``BUCKETS`` numbers a language) are summed where they
lie. Prediction sees the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0 and not
ambiguous; with nothing to learn from, every text is ``und``, and an empty table gives an empty
result. Of languages that tie the first by name is predicted, and the text is ambiguous. Repeated
rows are predicted each for itself, texts of any length whole. A null doc_id is carried as null. Null
languages are not learned. ``predict`` reads no other columns; ``keep_identified`` carries them all,
whatever their names, and keeps all texts with a letter where there was nothing to learn from.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import arrow, durable, map_arrow, strings, tidy, with_ids

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
PER_LANGUAGE = 2000
#: Gap between the two best codewords, as a share of the best's probability, that counts as clear.
CLEAR = 0.2
#: Standard deviations below the usual fit that a text may lie; texts that all languages together count as in what is usual of
#: one; and by what few texts tell is widened: variances of m texts count 1 + (WIDE / m)^2 times, as few texts do not show what else is usual.
DEVIATIONS, FEW, WIDE = 6.0, 20, 200
#: Standard deviations among n-grams below their mean that an n-gram counts at most.
STRANGE = 3.0
#: A byte is in three 3-grams and four 4-grams, which therefore count as one observation.
_TOGETHER = 7
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters, and A-Z, mapped away; bytes of other letters stay as they are.
_FOLD = bytes(
    (b | 0x20) if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_SPACES = re.compile(rb" {2,}")


def ngrams(data: bytes) -> np.ndarray:
    """Buckets of the byte 3-grams and 4-grams of folded text, padded by a space at either end."""
    a = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    three = a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)
    four = three[:-1] | a[3:] << np.uint32(24)
    shift = np.uint32(32 - BUCKET_BITS)
    return np.concatenate(
        ((three * np.uint32(0x9E3779B1)) >> shift, (four * np.uint32(0x85EBCA77)) >> shift)
    ).astype(np.int64)


def fold(text: str) -> bytes:
    """Lower case, and each run of characters other than letters as one space (ASCII ones)."""
    return _SPACES.sub(b" ", text.lower().encode().translate(_FOLD)).strip(b" ")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 for each language; any two rows differ in many places.

    Up to seven languages have the exhaustive code, more have the best of seeded random codes.
    """
    if languages <= 1:
        return np.ones((languages, 1), np.float32)
    if languages <= 7:
        width = 2 ** (languages - 1) - 1
        rows = [[1] * width]
        for i in range(1, languages):
            run = 2 ** (languages - 1 - i)
            rows.append([-1 if (j // run) % 2 == 0 else 1 for j in range(width)])
        return np.array(rows, np.float32)
    width = max(15, math.ceil(10 * math.log2(languages)))
    best, best_distance = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (languages, width))
        code = code[:, np.abs(code.sum(0)) < languages]
        distance = min(((a != b).sum() for i, a in enumerate(code) for b in code[:i]))
        if distance > best_distance:
            best, best_distance = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log-odds of the +1 side
    reliability: np.ndarray  # bits
    scale: float
    mixture: np.ndarray  # buckets, log-likelihood under the learned languages together
    usual: np.ndarray  # languages x (fit, variance among texts, variance among n-grams); not a number if unknown

    def __post_init__(self):
        self.table = np.column_stack((self.weights, self.mixture)).astype(np.float32)

    def means(self, data: bytes) -> tuple[np.ndarray, int]:
        """A text's value for each bit and, last, its fit; and its number of n-grams."""
        at = ngrams(data)
        total = np.zeros(self.table.shape[1])
        for i in range(0, len(at), 1 << 18):
            total += self.table[at[i : i + (1 << 18)]].sum(0)
        return (total / max(len(at), 1)).astype(np.float32), len(at)

    def least_fit(self, grams: np.ndarray) -> np.ndarray:
        """The least fit of texts of so many n-grams for each language; no bound where the usual fit is unknown."""
        fit, among_texts, among_grams = self.usual.T
        bound = fit - DEVIATIONS * np.sqrt(among_texts + _TOGETHER * among_grams / np.maximum(grams, 1)[:, None])
        return np.nan_to_num(bound, nan=-np.inf)

    def decode(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and ambiguity of rows of bit values."""
        margins = values[:, None, :] * self.code[None] * self.scale
        loss = (np.logaddexp(0, -margins) * self.reliability).sum(2)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        if odds.shape[1] == 1:
            return best, odds[:, 0], np.zeros(len(best), bool)
        two = np.sort(odds, 1)[:, -2:]
        return best, two[:, 1], (two[:, 1] - two[:, 0]) < CLEAR * two[:, 1]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(df: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of the id."""
    sizes = durable(df.groupBy("lang").count())  # a row for each language
    share = F.xxhash64("doc_id", F.lit(4)) % 1_000_003
    rows = df.join(sizes, "lang")
    return rows.where(F.abs(share) * F.col("count") < F.lit(per_language) * 1_000_003).drop("count")


@tidy
def fit(
    df: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Learn from the non-null languages of ``df``, which holds training rows only.

    Counting and measuring are one job each; what comes to the driver is a table of counts for
    each language and half, summed by the executors, and a number for each row of the sample.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = _sample(rows.where("lang is not null and text is not null"), per_language)
    # Dealt by row, so that a few long texts or one language do not make one task.
    rows = durable(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism))

    def packed(sums: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang for lang, _ in sums], pa.string()), pa.array([half for _, half in sums], pa.int32()),
                pa.array([zlib.compress(total.astype("<i8").tobytes(), 1) for total in sums.values()], pa.binary()),
            ],
            ["lang", "half", "counts"],
        )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two halves of the ids apart: weights come from one, the bits' reliability from the other.
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                if has_letter(text):
                    key = lang, _half(doc_id)
                    sums[key] = sums.get(key, 0) + np.bincount(ngrams(fold(text)), minlength=BUCKETS)
        yield packed(sums)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, half, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[lang, half] = sums.get((lang, half), 0) + np.frombuffer(zlib.decompress(data), "<i8")
        yield packed(sums)

    schema = "lang string, half int, counts binary"
    counted = arrow(arrow(rows, count, schema).repartition("lang", "half"), add, schema)
    halves = {(r["lang"], r["half"]): np.frombuffer(zlib.decompress(bytes(r["counts"])), "<i8") for r in counted.collect()}
    languages = sorted({lang for lang, _ in halves})
    none = np.zeros(BUCKETS, np.int64)
    totals = [[halves.get((lang, h), none) for lang in languages] for h in (0, 1)]
    model = learn(languages, np.array(totals, np.float64))
    if not languages:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits of the code

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                if _half(doc_id) == 1 and has_letter(text):
                    found.append((lang, float(shared.value.means(fold(text))[0][-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "fit"]
            )

    fits: dict[str, list[float]] = {lang: [] for lang in languages}
    for row in arrow(rows, measure, "lang string, fit double").collect():
        fits[row["lang"]].append(row["fit"])
    model.usual = usual_fit(model.mixture, [np.array(fits[lang]) for lang in languages], np.array(totals, np.float64)[1:].sum(0))
    return model


def _half(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) >> 5 & 1


def usual_fit(mixture: np.ndarray, fits: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """``Model.usual`` from the fits and the n-gram counts of the texts that the mixture was not learned from.

    Median and lower spread, as texts with a wrong language in the sample would move a mean. What few texts tell is drawn
    to the values of all languages together, and its variance widened, so that there is a bound at every size: the wider the fewer
    they are. There is none only where no text calibrates.
    """

    def values(own: np.ndarray, total: np.ndarray) -> np.ndarray:
        if not len(own) or not total.sum():
            return np.full(3, np.nan)
        share = total / total.sum()
        middle = float(np.median(own))
        spread = 1.4826 * float(np.median(middle - own[own <= middle]))
        return np.array([middle, spread**2, float(share @ mixture**2 - (share @ mixture) ** 2)])

    if not fits:
        return np.full((0, 3), np.nan)
    whole, m = values(np.concatenate(fits), counts.sum(0)), sum(map(len, fits))
    out = []
    for own, total in zip(fits, counts, strict=True):
        n = len(own) if total.sum() else 0
        told = (n * np.nan_to_num(values(own, total)) + FEW * whole) / (n + FEW)
        wider = 1 + (WIDE / max(m, 1)) ** 2
        out.append(told * [1, wider, wider])
    return np.array(out)


def learn(languages: list[str], totals: np.ndarray) -> Model:
    """A model from n-gram counts, shape (2 halves, languages, buckets)."""
    code = codewords(len(languages))
    if not len(languages):
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.ones(1), 1.0, np.zeros(BUCKETS), np.full((0, 3), np.nan))

    def shares(counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)  # languages weigh alike

    def weights(counts: np.ndarray) -> np.ndarray:
        share = shares(counts)
        columns = []
        for bit in code.T:
            if (bit > 0).all() or (bit < 0).all():
                columns.append(np.zeros(BUCKETS))
            else:
                columns.append(np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)))
        return np.stack(columns, 1)

    first, whole = weights(totals[0]), weights(totals.sum(0))
    other = totals[1] / np.maximum(totals[1].sum(1, keepdims=True), 1)
    seen = other @ first * code  # mean margin of each language and bit on the half not learned from
    reliability = np.clip(seen.min(0), 0, None) if (totals[1].sum(1) > 0).all() else np.ones(code.shape[1])
    reliability = reliability / reliability.mean() if reliability.sum() else np.ones(code.shape[1])
    own = ((totals.sum(0) / np.maximum(totals.sum((0, 2)), 1)[:, None]) @ whole * code).mean()
    mixture = np.log(shares(totals[0]).mean(0))
    share = (totals[0] / np.maximum(totals[0].sum(1, keepdims=True), 1)).mean(0)
    middle = share @ mixture
    # What no language has counts as STRANGE standard deviations at most, so that a name or a key in a short text does not decide.
    mixture = np.maximum(mixture, middle - STRANGE * np.sqrt(max(share @ mixture**2 - middle**2, 0)))
    unknown = np.full((len(languages), 3), np.nan)
    return Model(languages, code, whole.astype(np.float32), reliability, float(4 / own) if own > 0 else 1.0, mixture, unknown)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score, ambiguous, n_letters (bytes of folded text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits of the code

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _predicted(shared.value, batch.column(id_col).cast(pa.int64()), strings(batch, text_col))

    return map_arrow(
        with_ids(df, id_col), [id_col, text_col], run,
        "doc_id long, lang_pred string, score double, ambiguous boolean, n_letters long",
    )


def labels(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Language, score, ambiguity, letters of each text, and whether it fits the learned languages."""
    letters = [has_letter(t) for t in texts]
    folded = [fold(t) if ok else b"" for t, ok in zip(texts, letters, strict=True)]
    if not model.languages or not texts:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool), [len(f) for f in folded], np.ones(len(texts), bool)
    found = [model.means(f) for f in folded]
    values = np.array([f[0] for f in found], np.float32)
    best, score, ambiguous = model.decode(values[:, :-1])
    bounds = model.least_fit(np.array([f[1] for f in found]))
    # A text between languages may be of several; the loosest of their bounds is its own.
    bound = np.where(ambiguous, bounds.min(1), bounds[np.arange(len(texts)), best])
    ok = np.array(letters)
    names = [model.languages[b] if o else "und" for b, o in zip(best, letters, strict=True)]
    return names, np.where(ok, score, 0.0), ambiguous & ok, [len(f) for f in folded], values[:, -1] >= bound


def _predicted(model: Model, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    names, score, ambiguous, letters, _ = labels(model, texts)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_()), pa.array(letters, pa.int64())],
        ["doc_id", "lang_pred", "score", "ambiguous", "n_letters"],
    )


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is identified, with their columns.

    A row goes if its text is null or has no letter, or if its fit is below the bound for its language
    and number of n-grams. A short text may be unclear for want of evidence, and one of two languages is
    ambiguous, but neither is without a language; both stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch, text_col)
            fits = labels(shared.value, texts)[-1]
            yield batch.filter(pa.array([has_letter(t) and bool(f) for t, f in zip(texts, fits, strict=True)], pa.bool_()))

    return arrow(df, run, df.schema)
