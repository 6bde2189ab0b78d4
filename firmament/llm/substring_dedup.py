"""Repeated passages: every document is parsed greedily against indexed blocks of reference text (relative Lempel-Ziv).

A window is `width` consecutive words. A word goes if a window that covers it starts anywhere else too. All documents are reference and
are parsed; a block of reference holds the pieces of text that can match one another, so each piece is parsed against the one block where
its long factors can be:

1. Every window has an anchor, the `anchor`-word run in it with the least hash (leftmost of equal ones). Equal windows have equal anchors. Windows of
   one document that share an anchor's place form a piece of at most 2 * width - anchor - 1 words. `anchor_counts` counts the pieces of every
   anchor (map-side, packed). A window whose anchor has one piece in the corpus is unique: its text goes nowhere.
2. The other pieces travel, as word hashes, to blocks (ranges of hashed anchors; their number follows the counted windows, so a block has a
   bounded size). A block's index is the sorted order of all its suffixes with their common prefixes. Greedy parsing of a piece
   takes the longest factor at its first word; a factor of `width` words or more is a repeat and parsing resumes at its boundary, with the
   first window that crosses it; a shorter one is a literal word.
3. An anchor of more than `crowd` pieces (a passage in a third of all documents, say) would fill its block. Its windows are counted by a
   128-bit fingerprint instead, with map-side combining, which gives the same answer without gathering them.
4. What comes back are exceptions only: unique windows of pieces whose anchor is shared. They belong to one document each, so neither copies nor
   hot passages make a hot join key; texts without exceptions meet no shuffle.

Word hashes have 64 bits. Two bitmaps tell shared and crowded anchors; their size follows the number of shared anchors up to `max_bits`
(32 MB). Beyond that, bits shared by chance send some pieces to blocks needlessly and lose nothing.

Null text has no words. Words are runs of anything but ASCII white space and are compared unchanged. A text of fewer than `width` words has no
window. Rows are judged each, also rows that repeat an id, or id and text (which then repeat one another). Texts may be of any length; a text
is worked on whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import _BASE, _INVERSE, _PLACE, _powers, key_counts, marked, marks, mix, packed, slices, table, word_spans
from firmament.llm.registry import query
from firmament.session import cut_lineage

SALT = np.uint64(0x5851F42D4C957F2D)
BLOCK_WINDOWS = 60_000    # windows of a block of reference text, on average
SHARD_KEYS = 4_000_000    # anchors counted in one group


@dataclass(frozen=True)
class Shape:
    """Words of a window and of an anchor."""

    width: int = 35
    anchor: int = 12

    def __post_init__(self) -> None:
        if not 1 <= self.anchor <= min(self.width, len(_PLACE)) or self.width - self.anchor > 30:
            raise ValueError("an anchor has 1 to 32 words, at most 30 less than a window")


class Pieces:
    """The pieces of the rows of a string column: runs of windows that share the place of their anchor."""

    def __init__(self, column: pa.Array, shape: Shape) -> None:
        self.raw, self.starts, self.ends, self.words, self.bounds = word_spans(column)
        n = max(0, len(self.words) - shape.width + 1)  # windows, those across rows included
        valid = np.zeros(n + 1, np.int32)
        size = np.diff(self.bounds)
        whole = size >= shape.width
        np.add.at(valid, self.bounds[:-1][whole], 1)
        np.add.at(valid, self.bounds[1:][whole] - shape.width + 1, -1)
        valid = np.cumsum(valid)[:n] > 0
        grams = np.zeros(n + shape.width - shape.anchor if n else 0, np.uint64)
        for k in range(shape.anchor):
            grams += self.words[k:k + len(grams)] * _PLACE[k]
        grams = mix(grams)
        reach = shape.width - shape.anchor + 1
        place = np.arange(n) + (np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) if n else 0)
        same = valid[1:] & valid[:-1] & (place[1:] == place[:-1])
        starts = valid.copy()
        starts[1:] &= ~same
        ends = valid.copy()
        ends[:-1] &= ~same
        self.first = np.flatnonzero(starts)            # first window of every piece, as word number in the column
        self.size = np.flatnonzero(ends) - self.first + 1  # its windows
        self.anchor = grams[place[self.first]] if n else grams
        self.row = np.searchsorted(self.bounds, self.first, "right") - 1

    def digests(self, shape: Shape) -> np.ndarray:
        """64-bit hashes of the pieces' words."""
        n = len(self.words)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * _powers("up", _BASE, n)[:n], out=total[1:])
        to = self.first + self.size + shape.width - 1
        return mix((total[to] - total[self.first]) * _powers("down", _INVERSE, n)[self.first] + self.size.astype(np.uint64))


class Bits:
    """A bitmap of hashed anchors."""

    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.bits, self.data = bits, data

    def has(self, anchors: np.ndarray) -> np.ndarray:
        at = spot(anchors, self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def spot(anchors: np.ndarray, bits: int) -> np.ndarray:
    return mix(anchors ^ SALT) >> np.uint64(64 - bits)


def _bitmap(found: DataFrame, column: int, bits: int) -> Bits:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(column):
                at = spot(np.frombuffer(k.as_buffer(), np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["spot"])

    rows = found.mapInArrow(unpack, "spot long").groupBy(F.floor(F.col("spot") / 32768).alias("bucket")).agg(
        F.expr("bitmap_construct_agg(spot % 32768)").alias("bitmap")).toArrow()  # at most 2**bits bits
    data = np.zeros(max(4096, 1 << (bits - 3)), np.uint8)
    for bucket, b in zip(rows.column("bucket").to_pylist(), rows.column("bitmap").to_pylist()):
        data[bucket * 4096:(bucket + 1) * 4096] = np.frombuffer(b, np.uint8)
    return Bits(bits, data)


def anchor_counts(src: DataFrame, shape: Shape, crowd: int, max_bits: int) -> tuple[Bits, Bits, int]:
    """Bitmaps of the anchors of two pieces or more and of those of more than `crowd`, and the pieces that go to blocks."""
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def keys_of(part: pa.RecordBatch):
        keys = Pieces(part.column(1), shape).anchor
        return keys, np.ones((len(keys), 1), np.uint32)

    def shared(keys: np.ndarray, counts: np.ndarray) -> dict:
        n = counts[:, 0]
        some = (n > 1) & (n <= crowd)
        return {"shared": packed([keys[n > 1]]), "crowded": packed([keys[n > crowd]]), "keys": [int((n > 1).sum())], "pieces": [int(n[some].sum())]}

    # An anchor for every few words of five bytes or so.
    shards = -(-size // (5 * SHARD_KEYS))
    found = cut_lineage(key_counts(src, keys_of, 1, shared, "shared binary, crowded binary, keys long, pieces long", text=1, shards=shards))
    total = found.agg(F.sum("keys"), F.sum("pieces")).first()
    bits = min(max_bits, max(18, int(16 * (total[0] or 0)).bit_length()))
    return _bitmap(found, 0, bits), _bitmap(found, 1, bits), total[1] or 0


def block_pieces(src: DataFrame, shape: Shape, shared, crowded, blocks: int) -> DataFrame:
    """block, n, key, first, words: the pieces of shared anchors; equal pieces of a run of texts are one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = Pieces(part.column(1), shape)
            live = np.flatnonzero(shared.value.has(p.anchor))
            live = live[~crowded.value.has(p.anchor[live])]
            _, at, n = np.unique(p.digests(shape)[live], return_index=True, return_counts=True)
            own = live[at]
            block = mix(p.anchor[own] + SALT) >> np.uint64(32)
            first = p.first[own]
            to = first + p.size[own] + shape.width - 1
            yield pa.RecordBatch.from_arrays([
                pa.array((block * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)), pa.array(n, pa.int64()), part.column(2).take(pa.array(p.row[own])),
                pa.array((first - p.bounds[p.row[own]]).astype(np.int32)), packed([p.words[a:b] for a, b in zip(first, to)])],
                ["block", "n", "key", "first", "words"])

    return src.mapInArrow(run, "block int, n long, key binary, first int, words binary")


def parse(words: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Greedy parsing of pieces (of `size` words each, one after the other) against the reference they make up: for every window of
    every piece in order, whether it lies in a factor of `width` words or more."""
    runs = size - width + 1
    piece = np.repeat(np.arange(len(size)), runs)
    base = np.cumsum(runs) - runs
    off = np.arange(len(piece)) - base[piece]
    left = size[piece] - off                       # words from this suffix to the end of its piece
    span = int(left.max(initial=width))
    text = np.concatenate([words, np.zeros(span, np.uint64)])
    suffix = np.lib.stride_tricks.sliding_window_view(text, span)[(np.cumsum(size) - size)[piece] + off]
    suffix[left[:, None] <= np.arange(span)] = 0
    order = np.argsort(suffix.view(f"S{8 * span}").ravel())
    longest = np.zeros(len(order), np.int64)
    for at in range(0, len(order) - 1, 1 << 15):   # common prefixes of neighbours in the index
        a, b = order[at:-1][:1 << 15], order[at + 1:][:1 << 15]
        unlike = suffix[a] != suffix[b]
        common = np.minimum(np.where(unlike.any(axis=1), unlike.argmax(axis=1), span), np.minimum(left[a], left[b]))
        np.maximum.at(longest, a, common)
        np.maximum.at(longest, b, common)
    inside = np.zeros(len(piece) + 1, np.int32)
    at, end = base, base + runs
    while len(at):
        factor = longest[at] >= width
        over = np.minimum(at + longest[at] - width + 1, end)  # the first window that crosses the factor's end
        np.add.at(inside, at[factor], 1)
        np.add.at(inside, over[factor], -1)
        at = np.where(factor, over, at + 1)
        at, end = at[at < end], end[at < end]
    return np.cumsum(inside)[:-1] > 0


def block_exceptions(pieces: DataFrame, shape: Shape) -> DataFrame:
    """key, first, unique: pieces with windows that start nowhere else; bit i of `unique` is window first + i."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lone = group.column("n").to_numpy() == 1
        buffers = [np.frombuffer(w.as_buffer(), np.uint64) for w in group.column("words")]
        size = np.array([len(w) for w in buffers])
        found = parse(np.concatenate(buffers), size, shape.width)
        base = np.cumsum(size - shape.width + 1) - (size - shape.width + 1)
        off = np.arange(len(found)) - np.repeat(base, size - shape.width + 1)
        unique = np.add.reduceat(np.where(found, 0, 1 << off), base)
        keep = pa.array(lone & (unique != 0))
        return pa.table({"key": group.column("key").filter(keep), "first": group.column("first").filter(keep), "unique": pa.array(unique).filter(keep)})

    return pieces.groupBy("block").applyInArrow(run, "key binary, first int, unique long")


def crowd_exceptions(src: DataFrame, shape: Shape, shared, crowded) -> DataFrame:
    """The same for windows of crowded anchors, counted by fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = Pieces(part.column(1), shape)
            live = np.flatnonzero(crowded.value.has(p.anchor) & shared.value.has(p.anchor))
            at = np.repeat(p.first[live], p.size[live]) + np.arange(p.size[live].sum()) - np.repeat(np.cumsum(p.size[live]) - p.size[live], p.size[live])
            one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for k in range(shape.width):
                w = p.words[at + k]
                one = mix(one + w + np.uint64(k))
                two = (two ^ w) * SALT + (one >> np.uint64(7))
            _, pick, n = np.unique(one, return_index=True, return_counts=True)
            row = np.searchsorted(p.bounds, at[pick], "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(one[pick].view(np.int64)), pa.array(two[pick].view(np.int64)), pa.array(n, pa.int64()),
                part.column(2).take(pa.array(row)), pa.array((at[pick] - p.bounds[row]).astype(np.int32))], ["one", "two", "n", "key", "first"])

    windows = src.mapInArrow(run, "one long, two long, n long, key binary, first int")
    counted = windows.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min(F.struct("key", "first")).alias("at"))
    return counted.where("n = 1").select("at.key", "at.first", F.lit(1).cast("long").alias("unique"))


def _flat(kept: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets): the kept words of every row joined by one space."""
    size = (p.ends - p.starts)[kept]
    words = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=words[1:])
    words = words[p.bounds]                       # kept words before every row
    row = np.repeat(np.arange(len(p.bounds) - 1), np.diff(words))
    last = np.zeros(len(size), bool)
    last[words[1:][np.diff(words) > 0] - 1] = True
    step = size + ~last                           # a space after all but a row's last word
    at = np.cumsum(step) - step
    out = np.full(int(step.sum()), 32, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + within] = p.raw[np.repeat(p.starts[kept], size) + within]
    return out, np.concatenate(([0], np.cumsum(np.bincount(row, weights=step, minlength=len(p.bounds) - 1).astype(np.int64))))


def _cut(src: DataFrame, shape: Shape, shared) -> DataFrame:
    """id, n_words, n_removed, kept_text, spans of texts with their exceptions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = Pieces(part.column(1), shape)
            live = shared.value.has(p.anchor)
            repeat = np.zeros(len(p.words) + 1, np.int32)  # +1 where covered words begin, -1 where they end
            window = np.zeros(len(p.words) + 1, np.int32)
            np.add.at(window, p.first[live], 1)
            np.add.at(window, (p.first + p.size)[live], -1)
            window = np.cumsum(window)[:-1] > 0
            odd = part.column(2)
            if odd.null_count < len(odd):
                flat = odd.flatten()
                row = np.repeat(np.arange(len(odd)), odd.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                first = p.bounds[row] + flat.field(0).to_numpy(zero_copy_only=False)
                unique = flat.field(1).to_numpy(zero_copy_only=False)
                for k in range(shape.width - shape.anchor + 1):
                    window[first[unique >> k & 1 > 0] + k] = False
            at = np.flatnonzero(window)
            np.add.at(repeat, at, 1)
            np.add.at(repeat, at + shape.width, -1)
            gone = np.cumsum(repeat)[:-1] > 0
            out, offsets = _flat(~gone, p)
            total = np.concatenate(([0], np.cumsum(gone)))
            begin, end = gone.copy(), gone.copy()
            begin[1:] &= ~gone[:-1]
            end[:-1] &= ~gone[1:]
            heads, tails = p.bounds[:-1][np.diff(p.bounds) > 0], p.bounds[1:][np.diff(p.bounds) > 0] - 1
            begin[heads] |= gone[heads]
            end[tails] |= gone[tails]
            begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
            row = np.searchsorted(p.bounds, begin, "right") - 1
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, p.bounds).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array((x - p.bounds[row]).astype(np.int32)) for x in (begin, end)], ["start", "end"]))
            kept = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.diff(p.bounds).astype(np.int64)), pa.array(np.diff(total[p.bounds])), kept.cast(pa.string()), spans],
                ["id", "n_words", "n_removed", "kept_text", "spans"])

    return src.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(), crowd: int = 1024, max_bits: int = 28) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (kept words joined by one space), spans (removed words, [start, end) in words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.col("text"))))
    src = src.withColumn("key", key)
    send = docs.sparkSession.sparkContext.broadcast
    shared, crowded, pieces = anchor_counts(src.select("id", "text"), shape, crowd, max_bits)
    shared, crowded = send(shared), send(crowded)
    blocks = max(1, -(-pieces * (shape.width - shape.anchor + 2) // (2 * BLOCK_WINDOWS)))
    odd = block_exceptions(block_pieces(src, shape, shared, crowded, blocks), shape).unionByName(crowd_exceptions(src, shape, shared, crowded))
    odd = cut_lineage(odd.groupBy("key").agg(F.collect_list(F.struct("first", "unique")).alias("odd")))  # at most the windows of a text
    near = marked(src, F.col("key"), marks(odd, F.col("key")))
    plain = near.where("not _maybe").select("id", "text", F.lit(None).cast("array<struct<first:int,unique:bigint>>").alias("odd"))
    rest = near.where("_maybe").select("id", "text", "key").join(odd, "key", "left").select("id", "text", "odd")
    return _cut(plain.unionByName(rest), shape, shared).withColumnRenamed("id", id_col)


@query("op13_substring_dedup", sql=r"""
    WITH w AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT r, p, list_slice(words, p, p + 34) AS win FROM w, unnest(range(1, len(words) - 33)) AS t(p)),
    d AS (SELECT r, p FROM s QUALIFY count(*) OVER (PARTITION BY hash(win), win) > 1),
    g AS (SELECT DISTINCT r, i FROM d, unnest(range(p, p + 35)) AS t(i)),
    k AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
           sha256(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(coalesce(gone, []), x[2])),
                                                 lambda x: x[1]), ' ')) AS kept_sha256
    FROM w LEFT JOIN k USING (r)""")
def op13_substring_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
