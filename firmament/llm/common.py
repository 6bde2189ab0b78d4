"""Helpers shared by the corpus operators: tables, text columns, word hashing over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, max_bytes: int = 1 << 22) -> None:
    """From here on the session hands Python its rows in Arrow batches of about `max_bytes`, where it has no limit of its own.

    Spark's bound is 10,000 rows of any size: with whole texts the JVM and the worker of every task each hold tens of megabytes at once. Rows stay whole.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(max_bytes))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows of about `max_bytes` of text, so that array work stays in bounded memory.

    At the end of a task its freed batches go back to the system: workers are kept for later tasks.
    """
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _POWERS[kind]
    if len(have) <= n:
        steps = np.full(max(n + 1, 1 << 20), np.uint64(base))
        steps[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(steps)
    return have


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words(column: pa.Array, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row bounds): the lower-cased (A-Z) words of every row; row r has words bounds[r]:bounds[r + 1].

    `gap` marks the bytes that part words. A word's hash is a polynomial over its bytes modulo 2**64, read off one running
    sum over the whole buffer, then mixed.
    """
    raw, offsets = utf8(column)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~gap[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[FOLD[raw]] * _powers("up", _BASE, n)[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _powers("down", _INVERSE, n)[starts])
    return hashes, np.searchsorted(starts, offsets)


def word_spans(column: pa.Array, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, word hashes, row bounds) of a string column, words unchanged; null counts as empty."""
    raw, offsets = utf8(column)
    n = len(raw)
    inside = ~gap[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | first[:n]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | first[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers("up", _BASE, n)[:n], out=total[1:])
    return raw, starts, ends, mix((total[ends] - total[starts]) * _powers("down", _INVERSE, n)[starts]), np.searchsorted(starts, offsets)


_PLACE = mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For every row, the sorted distinct hashes of its `width`-word shingles; a shorter text is one shingle, none if empty."""
    hashes, bounds = words(column)
    n = max(0, len(hashes) - width + 1)
    run = np.zeros(n, np.uint64)
    for k in range(width):
        run += hashes[k:k + n] * _PLACE[k]
    run = mix(run)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(run[a:b - width + 1])
        elif b > a:
            yield mix(np.atleast_1d((hashes[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)))
        else:
            yield run[:0]


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def marks(keys: DataFrame, key: Column, bits: int = 23) -> DataFrame:
    """A bitmap of fixed size (2**bits bits; 1 MB as set, whatever the input) of the hashed `key` of every row, for `marked`."""
    spot = keys.select(F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("_spot"))
    rows = spot.groupBy(F.floor(F.col("_spot") / 32768).alias("_bucket")).agg(F.expr("bitmap_construct_agg(_spot % 32768)").alias("_bitmap"))
    return F.broadcast(cut_lineage(rows))


def marked(df: DataFrame, key: Column, bitmap: DataFrame, bits: int = 23) -> DataFrame:
    """`df` with _maybe: false only where the key is surely not among the marked ones. A cheap filter before an exact join."""
    spot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(floor(_spot % 32768 / 8) as int) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_spot % 8 as int))")) > 0
    joined = df.withColumn("_spot", spot).withColumn("_bucket", F.floor(F.col("_spot") / 32768)).join(bitmap, "_bucket", "left")
    return joined.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_spot", "_bucket", "_bitmap")


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the summed rows of `counts` (keys x columns)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first, axis=0, dtype=counts.dtype)


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, which the shuffle's compression shrinks."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _undelta(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def key_counts(src: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], columns: int,
               reduce: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, text: int = 0,
               held: int = 1 << 20, uniform_bits: int = 0, shards: int = 0) -> DataFrame:
    """Count 64-bit keys over a whole table.

    `keys_of` gives the keys of a few rows and their counts (keys x `columns`, uint32). Counts are merged within a task while they fit
    in `held` keys, then travel as sorted arrays, one row for each key range; `reduce` gets the distinct keys of one range with
    their totals and returns columns of `schema`. Ranges are of hashed keys, so a frequent key is no hot task, and their number follows
    spark.sql.shuffle.partitions unless `shards` says more. `uniform_bits`: keys are themselves hashes of so many bits, so ranges may be of the keys.
    """
    shards = max(shards, 4 * max(1, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def pack(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        spread = keys >> np.uint64(uniform_bits - 32) if uniform_bits else mix(keys) >> np.uint64(32)
        shard = spread * np.uint64(shards) >> np.uint64(32)
        order = np.lexsort((keys, shard))
        keys, counts, shard = keys[order], counts[order], shard[order]
        at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        ends = [*at[1:], len(keys)]
        return pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array([_deltas(keys[a:b]) for a, b in zip(at, ends)], pa.binary()),
                                           packed([counts[a:b] for a, b in zip(at, ends)])], ["shard", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, kept = [], 0, (np.zeros(0, np.uint64), np.zeros((0, columns), np.uint32))
        for part in slices(batches, text=text):
            waiting.append(merge_counts(*keys_of(part)))
            n += len(waiting[-1][0])
            if n > held:
                kept = merge_counts(np.concatenate([kept[0], *(k for k, _ in waiting)]), np.concatenate([kept[1], *(c for _, c in waiting)]))
                waiting, n = [], 0
                if len(kept[0]) > held:
                    yield pack(*kept)
                    kept = kept[0][:0], kept[1][:0]
        kept = merge_counts(np.concatenate([kept[0], *(k for k, _ in waiting)]), np.concatenate([kept[1], *(c for _, c in waiting)]))
        if len(kept[0]):
            yield pack(*kept)

    def total(group: pa.Table) -> pa.Table:
        keys = np.concatenate([_undelta(b) for b in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(b, np.uint32).reshape(-1, columns) for b in group.column("counts").to_pylist()])
        return pa.table(reduce(*merge_counts(keys, counts.astype(np.uint64))))

    return src.mapInArrow(count, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(total, schema)


def write_table(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder (spark.checkpoint.dir) and read back: lineage is cut and Spark knows its size."""
    sc = df.sparkSession.sparkContext
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        cut_lineage(df.sparkSession.range(0))  # sets a folder of our own, as in tests
        shared = sc.getCheckpointDir()
    path = f"{shared}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose id is among `ids`; rows without id stay.

    A bitmap of the ids tells which rows cannot be among them; those pass without a shuffle of their text.
    """
    gone = cut_lineage(ids.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct())
    near = marked(docs.withColumn("_key", F.col(id_col)), F.col("_key"), marks(gone, F.col(id_col)))
    columns = [F.col(c) for c in docs.columns]
    return near.where("not _maybe").select(*columns).unionByName(near.where("_maybe").select(*columns).join(gone, id_col, "left_anti").select(*columns))
