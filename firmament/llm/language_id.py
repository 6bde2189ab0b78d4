"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For every bit a binary classifier over byte trigrams (letters only, case folded, other
bytes as one gap) tells the languages whose codeword has the bit from the rest. A text is decoded to the codeword with the
smallest loss: each bit's logistic loss counts by how well that bit's classifier did on that language in training. A text whose
two best codewords lie close together is flagged ambiguous.

Training reads labelled rows only, at most about `max_train_per_lang` of each language (chosen by a hash of the id; the one bounded
sample here) and is aggregated in Spark to (language, trigram cell) counts, of fixed size per language. Prediction is one map over
all rows and their whole texts, cut into runs of about a megabyte.

Null or letterless text is `und` with score 0. A text that ties takes the first language by name. With no labelled row at all every
text is `und`. Repeated rows get equal answers; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.llm.common import FOLD, slices, table, utf8
from firmament.llm.registry import query

CELLS = 1 << 16
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cells, owning row) of every byte trigram that holds a letter and stays within its row."""
    raw, offsets = utf8(column)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = FOLD[raw]
    letter = _LETTER[low]
    code = np.where(letter, low, 32).astype(np.uint32)
    cell = (code[:-2] * np.uint32(2654435761) ^ code[1:-1] * np.uint32(2246822519) ^ code[2:] * np.uint32(3266489917))
    cell = (cell * np.uint32(668265263)) >> np.uint32(16)
    inside = np.ones(len(raw), bool)
    for back in (1, 2):
        inside[np.maximum(offsets[1:] - back, 0)[offsets[1:] > 0]] = False
    at = np.flatnonzero(inside[:-2] & letter[1:-1])
    return cell[at].astype(np.int64), np.searchsorted(offsets, at, "right") - 1


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray      # languages x bits, +1 or -1
    weights: np.ndarray   # CELLS x bits: log odds of each trigram cell
    scale: np.ndarray     # bits: brings margins to a common size
    trust: np.ndarray     # languages x bits: weight of a bit's loss for a language

    def margins(self, column: pa.Array) -> np.ndarray:
        cells, rows = _trigrams(column)
        out = np.zeros((len(column), self.code.shape[1]), np.float64)
        if len(cells):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            sums = np.add.reduceat(self.weights[cells], first, axis=0).astype(np.float64)
            out[rows[first]] = sums / np.diff(np.append(first, len(cells)))[:, None]
        return out * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        loss = np.empty((len(margins), len(self.languages)))
        for k, (bits, trust) in enumerate(zip(self.code, self.trust)):
            loss[:, k] = (np.logaddexp(0, -margins * bits) * trust).sum(axis=1) / trust.sum()
        return loss

    def decode(self, column: pa.Array, gap: float) -> tuple[list, np.ndarray, np.ndarray]:
        """(language, score, ambiguous) for every text."""
        n = len(column)
        known = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), known.astype(bool)
        loss = self.losses(self.margins(column))
        best = loss.argmin(axis=1)
        share = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        score = np.where(known, share[np.arange(n), best], 0.0)
        ranked = np.sort(loss, axis=1)
        close = ranked[:, 1] - ranked[:, 0] < gap if loss.shape[1] > 1 else np.zeros(n, bool)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, close | ~known.astype(bool)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Up to seven classes: every split of the classes once. More: the random code, of 200 tried, whose words lie farthest apart."""
    if n <= 7:
        bits = range(1, max(2, 1 << (n - 1)))
        return np.array([[1 if k == 0 or not (b >> (k - 1)) & 1 else -1 for b in bits] for k in range(n)]).reshape(n, -1)
    draw, width, best = np.random.default_rng(seed), math.ceil(15 * math.log2(n)), None
    for _ in range(200):
        code = draw.choice((-1, 1), size=(n, width))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (width - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_train_per_lang: int = 2000, prior: float = 0.5) -> LanguageModel:
    """Learn from the rows of `docs` that have a language. Languages are few; they and their cell counts go to the driver."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(lang_col).count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((0, 1)), np.zeros((CELLS, 1), np.float32), np.ones(1), np.ones((0, 1)))
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(max_train_per_lang / n)) for k, n in sizes.items()])
    pick = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("train")), F.lit(1 << 30)) < share * (1 << 30)
    sample = named.where(pick).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=1):
            cells, rows = _trigrams(part.column(1))
            lang = np.array([languages.index(x) for x in part.column(0).to_pylist()], np.int64)
            key, n = np.unique(lang[rows] * CELLS + cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // CELLS), pa.array(key % CELLS), pa.array(n.astype(np.int64))], ["lang", "cell", "n"])

    counted = sample.mapInArrow(count, "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.full((len(languages), CELLS), 0.0)
    for r in counted.toArrow().to_batches():  # languages x CELLS entries at most
        counts[r.column(0).to_numpy(), r.column(1).to_numpy()] = r.column(2).to_numpy()
    smooth = counts + prior
    smooth /= smooth.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    sides = [((code == s).T.astype(float) @ smooth) / np.maximum(1, (code == s).sum(axis=0))[:, None] for s in (1, -1)]
    one_sided = (np.abs(code.sum(axis=0)) == len(languages))[:, None]
    weights = np.where(one_sided, 1.0, np.log(np.maximum(sides[0], 1e-12)) - np.log(np.maximum(sides[1], 1e-12))).T.astype(np.float32)
    flat = LanguageModel(languages, code, np.ascontiguousarray(weights), np.ones(code.shape[1]), np.ones(code.shape))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=1):
            m = flat.margins(part.column(1))
            bits = m.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([languages.index(x) for x in part.column(0).to_pylist()], bits).astype(np.int64)),
                pa.array(np.tile(np.arange(bits), len(m)).astype(np.int64)), pa.array(m.ravel())], ["lang", "bit", "margin"])

    right, size = np.zeros(code.shape), np.zeros(code.shape)
    seen = sample.mapInArrow(judge, "lang long, bit long, margin double").groupBy("lang", "bit").agg(
        F.avg((F.col("margin") > 0).cast("double")).alias("up"), F.avg(F.abs("margin")).alias("size"))
    for r in seen.collect():  # languages x bits rows
        right[r.lang, r.bit] = r.up if code[r.lang, r.bit] > 0 else 1 - r.up
        size[r.lang, r.bit] = r.size
    scale = 2 / np.maximum(size.mean(axis=0), 1e-6)
    return LanguageModel(languages, code, flat.weights, scale, np.maximum(right, 0.05))


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", gap: float = 0.02) -> DataFrame:
    """All columns of `docs` with lang_pred, score and ambiguous added."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    src = docs.select(*keep)
    at = keep.index(text_col)
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("ambiguous", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=at, max_bytes=1 << 18):
            lang, score, close = model.decode(part.column(at), gap)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(close)],
                                             [*part.schema.names, "lang_pred", "score", "ambiguous"])

    return src.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify_languages(slim, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
