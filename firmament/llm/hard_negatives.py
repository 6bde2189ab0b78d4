"""Hard negatives of anchor vectors by exact integer scores from a residue-number-system matrix product.

Components become floor(scale * x). A score is the integer inner product. It is computed in float32 and is exact all the same:

1. Components are reduced to centred residues modulo several small primes, so small that a product of `chunk` components stays below 2**24,
   up to which float32 holds every integer. One float32 matrix product a prime gives the scores' residues.
2. Enough primes are taken that their product exceeds twice the largest possible score (from the largest component of the table), so the
   signed score is rebuilt by Chinese remaindering in mixed radix: in 64 bits where the product of the primes fits, else in Python integers.
3. Windowed selection: an anchor's positives are its first rows of the same label; a positive's negatives are the first rows of another label
   whose score lies between `lower` and `upper` percent of the positive's.

Anchors are a stated query set against all rows. They are dealt into blocks of about `block` rows; a block (at most a few MB, whatever the
table) is broadcast, and all rows stream past it twice, for positives and for negatives. Vectors are never shuffled: a task sends on the
first rows of every anchor that it has met, and window ranks pick the final ones. The cost is that of the product itself, anchors x rows.
Results of a block are a written table, so a lost executor costs tasks and not blocks.

Rows without id, label or vector, or with a null or non-finite component (after scaling), take no part. Vectors of other lengths count as
padded with zeros; an empty vector scores 0. Ties go to the smaller id. Rows that repeat an id at the same score count once for an anchor, and an
anchor is no partner of any row of its own id. A score beyond 64 bits counts as the nearest long. An empty table, or one without anchors,
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.llm.common import table, write_table
from firmament.llm.registry import query
from firmament.session import cut_lineage

EXACT = 1 << 24      # float32 holds every integer up to here
ROWS = 2048          # rows of a tile of scores
ANCHORS = 512        # anchors of a tile
LONG = (1 << 63) - 1


def primes_below(n: int) -> list[int]:
    """Odd primes up to n, largest first."""
    return [p for p in range(n if n % 2 else n - 1, 2, -2) if all(p % q for q in range(3, isqrt(p) + 1, 2))]


@dataclass
class Residues:
    """Primes for vectors of `dims` components whose inner products lie within +-bound, and the products of the primes so far."""

    dims: int
    bound: int
    chunk: int = field(init=False)
    primes: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.chunk = max(1, min(self.dims, 4096))
        while True:
            self.primes, product = [], 1
            for p in primes_below(2 * isqrt(EXACT // self.chunk) + 1):
                if product > 2 * self.bound + 1:
                    break
                self.primes.append(p)
                product *= p
            if product > 2 * self.bound + 1 or self.chunk == 1:
                break
            self.chunk = -(-self.chunk // 2)
        self.product = product
        self.dtype = np.int64 if product <= LONG else object

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """Centred residues of integer-valued doubles, one float32 matrix a prime. fmod is exact at any size."""
        out = []
        for p in self.primes:
            r = np.fmod(x, p)
            out.append((r - p * np.rint(r / p)).astype(np.float32))
        return out

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Exact inner products of every row of `a` with every row of `b`, given as residues."""
        digits: list[np.ndarray] = []
        for p, x, y in zip(self.primes, a, b):
            rest = np.zeros((len(x), len(y)), np.int64)
            for at in range(0, max(1, self.dims), self.chunk):
                rest += (x[:, at:at + self.chunk] @ y[:, at:at + self.chunk].T).astype(np.int64)
                rest %= p
            weight = 1
            for q, digit in zip(self.primes, digits):  # take off the digits found, then divide by the primes before
                rest = (rest - digit * weight) % p
                weight = weight * q % p
            digits.append(rest * pow(weight, -1, p) % p)
        value, weight = np.zeros(digits[0].shape, self.dtype), 1
        for p, digit in zip(self.primes, digits):
            value = value + digit.astype(self.dtype) * weight
            weight *= p
        value = np.where(value > self.product // 2, value - self.product, value)
        return value if self.dtype is np.int64 else np.clip(value, -LONG - 1, LONG).astype(np.int64)


class First:
    """The first `k` (score, id) of every slot: highest scores, then smallest ids; equal pairs once."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.floor = k, np.full(slots, -LONG - 1)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def push(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order round without overflow
        slot, score, ids = slot[order], score[order], ids[order]
        if len(slot):
            new = np.concatenate(([True], (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])))
            slot, score, ids = slot[new], score[new], ids[new]
            place = np.arange(len(slot)) - np.searchsorted(slot, slot)
            full = place == self.k - 1
            self.floor[slot[full]] = score[full]
            slot, score, ids = slot[place < self.k], score[place < self.k], ids[place < self.k]
        self.slot, self.score, self.id = slot, score, ids


def matrix(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, rows x dims; shorter vectors are padded with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims))
    at = np.repeat(np.arange(len(vectors)), sizes)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _pick(rows: DataFrame, residues: Residues, scale: int, k: int, anchors: dict, slots: dict, same: bool) -> DataFrame:
    """slot, score, id: within every task, the first `k` rows of each slot.

    A slot belongs to an anchor (`slots`: its row, and the least and largest score allowed) and takes rows of the anchor's label
    (`same`) or of other labels.
    """
    sent = rows.sparkSession.sparkContext.broadcast((anchors, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, slot = sent.value
        ours = residues.split(who["x"])
        first = First(len(slot["row"]), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                theirs = residues.split(matrix(part.column(2), residues.dims, scale))
                for a in range(0, len(who["id"]), ANCHORS):
                    score = residues.scores([x[a:a + ANCHORS] for x in ours], theirs)
                    alike = who["label"][a:a + ANCHORS, None] == labels
                    fits = (alike if same else ~alike) & (who["id"][a:a + ANCHORS, None] != ids)
                    found = [[], [], []]
                    mine = np.flatnonzero((slot["row"] >= a) & (slot["row"] < a + ANCHORS))
                    turn = slot["turn"][mine]
                    for t in range(int(turn.max(initial=-1)) + 1):  # one slot of every anchor a turn
                        s = mine[turn == t]
                        r = slot["row"][s] - a
                        low = np.maximum(slot["low"][s], first.floor[s])
                        ok = fits[r] & (score[r] >= low[:, None]) & (score[r] <= slot["high"][s][:, None])
                        i, j = np.nonzero(ok)
                        for to, x in zip(found, (s[i], score[r[i], j], ids[j])):
                            to.append(x)
                    if any(len(x) for x in found[0]):
                        first.push(*(np.concatenate(x) for x in found))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first.slot, first.score, first.id)], ["slot", "score", "id"])

    return rows.mapInArrow(run, "slot long, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, mine: pa.Table, residues: Residues, scale: int, positives: int, negatives: int, lower: int, upper: int) -> DataFrame:
    """The hard negatives of one block of anchors."""
    anchors = {"id": mine.column("id").to_numpy(), "label": mine.column("label").to_numpy(), "x": matrix(mine.column("vec"), residues.dims, scale)}
    n = len(anchors["id"])
    every = {"row": np.arange(n), "turn": np.zeros(n, np.int64), "low": np.full(n, -LONG - 1), "high": np.full(n, LONG)}
    best = _ranked(_pick(rows, residues, scale, positives, anchors, every, True), positives).orderBy("slot", "rank").toArrow()  # at most positives a row
    row, score, partner = (best.column(c).to_numpy() for c in ("slot", "score", "id"))
    low, high = ([max(-LONG - 1, min(LONG, int(f(int(s))))) for s in score] for f in (lambda s: -(-lower * s // 100), lambda s: upper * s // 100))
    slots = {"row": row, "turn": best.column("rank").to_numpy().astype(np.int64) - 1, "low": np.array(low, np.int64), "high": np.array(high, np.int64)}
    hard = _ranked(_pick(rows, residues, scale, negatives, anchors, slots, False), negatives)
    named = rows.sparkSession.createDataFrame(pa.table({
        "slot": pa.array(np.arange(len(row)), pa.int64()), "anchor_id": pa.array(anchors["id"][row], pa.int64()),
        "positive_id": pa.array(partner, pa.int64()), "positive_score": pa.array(score, pa.int64())}))
    return hard.join(F.broadcast(named), "slot").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: int = 256, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100, block: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the module's head. `is_anchor` may use any column."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    size = rows.agg(F.max(F.size("vec")).alias("dims"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    none = vectors.sparkSession.createDataFrame([], schema)
    if size.dims is None:
        return none
    most = int(np.floor(scale * (size.most or 0.0))) + 1
    residues = Residues(max(1, size.dims), size.dims * most * most)
    anchors = cut_lineage(rows.where("_anchor").drop("_anchor").distinct())
    blocks = -(-anchors.count() // block)
    anchors = anchors.withColumn("_block", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(max(1, blocks))))
    rows, out = rows.drop("_anchor"), []
    for b in range(blocks):
        mine = anchors.where(F.col("_block") == b).toArrow()
        if mine.num_rows:
            out.append(write_table(_block(rows, mine, residues, scale, positives, negatives, lower, upper)))
    return reduce(DataFrame.unionByName, out, none) if len(out) != 1 else out[0]


@query("op11_hard_negatives", sql="""
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= 5""")
def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)
