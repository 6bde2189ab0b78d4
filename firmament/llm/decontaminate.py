"""Benchmark decontamination: which documents hold a benchmark item, up to a share of word edits.

Texts are sequences of lower-cased words of letters and digits. A window of the size of an item, at any word of any document, is a
match when its edit distance to the item (in words) is at most max_edit * item length.

1. A q-gram count, exact: a window within d edits of an item of m words holds m - 1 - 2d word pairs of items, so windows with fewer
   in their first words need no embedding. Running sums over a whole slice decide it for every start.
2. CGK embedding: a random walk over the window repeats each word zero or more times by random bits of (step, word), which
   maps edit distance to Hamming distance. The walk is made for all live starts at once, in numpy.
3. Bit sampling: `repeats` times, `bits` random coordinates of the whole embedding form a key; a window whose key equals an item's is a
   candidate. Coordinates are read in step order and a start leaves as soon as no item agrees. Items are grouped by octave of length
   so that walks fit the item's size.
4. Anchors, exact: an item cut into one segment more than its edits has a segment that no match edits. The first words of every segment (8
   at most) are looked up wherever a document's word pairs are all known, so what sampling misses is a candidate too, of any length.
5. Every candidate is verified by an exact banded edit distance, from its start or to both sides of its anchor.

Items are sent to the tasks in blocks of at most `block_words` words, each block one pass over the documents, so what is sent is
bounded for any benchmark size. Items of up to six words allow no edit (at `max_edit` 0.15) and match where their words stand in a row. A caller
for whom short items are no evidence sets `min_words`: items of fewer words then match nothing. Items without words match nothing; null texts hold nothing;
items of equal words are one item with the least id, whatever block they fall in (`equal_items` lists them); repeated rows match each. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.llm.common import _PLACE, mix, slices, table, words
from firmament.llm.registry import query

GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
_PAIR = np.uint64(0xA24BAED4963EE407)


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * _PAIR + hashes[1:]) if len(hashes) > 1 else hashes[:0]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int]:
    """(distance, words of b used): the item `a` against the best prefix of `b`; more than `most` edits count as most + 1."""
    if most >= 12:
        at = np.arange(len(b) + 1)
        line = at
        for x in a:
            new = line + 1
            new[1:] = np.minimum(new[1:], line[:-1] + (b != x))
            line = np.minimum.accumulate(new - at) + at
            if line.min() > most:
                return most + 1, 0
        return (int(line.min()), int(line.argmin())) if line.min() <= most else (most + 1, 0)
    a, b = a.tolist(), b.tolist()
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most + 1) + 1
            if j:
                best = min(best, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
            new[j] = best
        row = new
        if not row or min(row.values()) > most:
            return most + 1, 0
    return min((n, j) for j, n in row.items())


@dataclass
class Octave:
    """Items of `size` to 2 * size - 1 words."""
    size: int
    items: list[np.ndarray]
    ids: list[int]
    edits: list[int]
    keys: list = field(default_factory=list)  # one (coordinates, levels, owners) a repeat


def moves_on(hashes: np.ndarray, repeat: int, step: int) -> np.ndarray:
    """0 or 1, a random bit of (repeat, step, word): whether a walk that stands on the word at that step moves on."""
    bits = mix(hashes ^ mix(np.array([repeat * 977 + 13 + (step // 64 << 32)], np.uint64)))
    return ((bits >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)


def anchor_hashes(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return mix(sum(hashes[at + k] * _PLACE[k] for k in range(length)))


class Items:
    """A block of items prepared for search."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], max_edit: float, repeats: int, bits: int, seed: int):
        self.octaves: list[Octave] = []
        for size in sorted({1 << (len(w).bit_length() - 1) for _, w in rows}):
            own = [(i, w) for i, w in rows if 1 << (len(w).bit_length() - 1) == size]
            o = Octave(size, [w for _, w in own], [i for i, _ in own], [int(max_edit * len(w)) for _, w in own])
            draw = np.random.default_rng(seed + size)
            for r in range(repeats):
                steps = np.sort(draw.choice(max(1, 3 * size // 2), size=min(bits, max(1, 3 * size // 2)), replace=False))
                chain, level = [], np.zeros(len(own), np.uint64)
                at, step = np.zeros(len(own), np.int64), 0
                flat, sizes = np.concatenate(o.items), np.array([len(w) for w in o.items])
                base = np.cumsum([0, *map(len, o.items[:-1])])
                for s in steps:
                    while step < s:
                        at = np.minimum(at + moves_on(flat[base + at], r, step), sizes - 1)
                        step += 1
                    level = mix(level * _PAIR + flat[base + at])
                    chain.append(np.unique(level))
                order = np.argsort(level, kind="stable")
                o.keys.append((steps, chain, level[order], order))
            self.octaves.append(o)
        self.rows = [(i, w, int(max_edit * len(w))) for i, w in rows]
        cut: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, w, edits) in enumerate(self.rows):
            ends = np.linspace(0, len(w), edits + 2).astype(int).tolist()
            for a, b in zip(ends, ends[1:]):
                length = min(b - a, 8)
                cut.setdefault(length, []).append((int(anchor_hashes(w, np.array([a]), length)[0]), k, a))
        #: length -> sorted hashes, and (item, place in the item) of each
        self.anchors = {n: (np.array([h for h, *_ in x], np.uint64), [y[1:] for y in x]) for n, x in ((n, sorted(x)) for n, x in cut.items())}
        pairs = np.concatenate([pair_hashes(w) for _, w in rows]) if rows else np.zeros(0, np.uint64)
        self.pairs = np.unique(pairs)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.pairs >> np.uint64(44)] = True

    def known_pairs(self, hashes: np.ndarray) -> np.ndarray:
        p = pair_hashes(hashes)
        out = self.table[p >> np.uint64(44)]
        at = np.flatnonzero(out)
        out[at] = _within(self.pairs, p[at])
        return out

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item id, first word, words, edits) of the best window of every (row, item)."""
        n = len(hashes)
        if not n or not self.octaves:
            return
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        known = self.known_pairs(hashes) & (row_of[1:] == row_of[:-1])
        sums = np.concatenate(([0], np.cumsum(known)))
        end_of = bounds[1:][row_of]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for o in self.octaves:
            most = max(o.edits)
            window = o.size
            least = max(1, window - 1 - 2 * most)
            start = np.arange(n)
            stop = np.minimum(start + window - 1, n - 1)
            live = start[(sums[stop] - sums[start] >= least) & (end_of - start >= max(1, window - most))]
            if not len(live):
                continue
            found: set[tuple[int, int]] = set()
            for r, (steps, chain, keys, owners) in enumerate(o.keys):
                at, last, level, who, step = live, end_of[live] - 1, np.zeros(len(live), np.uint64), live, 0
                for s, allowed in zip(steps, chain):
                    while step < s:
                        at = np.minimum(at + moves_on(hashes[at], r, step), last)
                        step += 1
                    level = mix(level * _PAIR + hashes[at])
                    ok = _within(allowed, level)
                    at, last, level, who = at[ok], last[ok], level[ok], who[ok]
                    if not len(at):
                        break
                if len(at):
                    lo, hi = np.searchsorted(keys, level), np.searchsorted(keys, level, "right")
                    for w, a, b in zip(who.tolist(), lo.tolist(), hi.tolist()):
                        found.update((w, int(k)) for k in owners[a:b])
            for w, k in sorted(found):
                item, edits = o.items[k], o.edits[k]
                seen = hashes[w:min(w + len(item) + edits, end_of[w])]
                if len(seen) < len(item) - edits or np.isin(item, seen).sum() < len(item) - edits:
                    continue
                d, used = edit_distance(item, seen, edits)
                key = int(row_of[w]), o.ids[k]
                if d <= edits and (key not in best or d < best[key][0]):
                    best[key] = d, w, used
        tried: set[tuple[int, int, int]] = set()
        for length, (keys, owners) in self.anchors.items():
            at = np.flatnonzero(sums[length - 1:] - sums[:max(0, len(sums) - length + 1)] == length - 1)
            if not len(at):
                continue
            h = anchor_hashes(hashes, at, length)
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                row = int(row_of[p])
                for k, place in owners[a:b]:
                    i, item, edits = self.rows[k]
                    if best.get((row, i), (1,))[0] == 0:
                        continue
                    # Anchors of one unedited run give one alignment.
                    same = hashes[max(int(bounds[row]), p - place):p][::-1]
                    same = np.flatnonzero(same != item[:place][::-1][:len(same)])
                    run = k, p - place, place - int(same[0]) if len(same) else -1
                    if run in tried:
                        continue
                    tried.add(run)
                    before = hashes[max(int(bounds[row]), p - place - edits):p][::-1]
                    after = hashes[p + length:min(p + len(item) - place + edits, int(bounds[row + 1]))]
                    if np.isin(item, np.concatenate((before, item[place:place + length], after))).sum() < len(item) - edits:
                        continue
                    d, left = edit_distance(item[:place][::-1], before, edits)
                    if d <= edits:
                        e, right = edit_distance(item[place + length:], after, edits - d)
                        if d + e <= edits and ((row, i) not in best or d + e < best[row, i][0]):
                            best[row, i] = d + e, p - left, left + length + right
        for (row, item), (d, w, used) in best.items():
            yield row, item, w - int(bounds[row]), used, d


def _within(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def equal_items(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, same_as): for every item with id and text, the least id among the items of equal words, under which `find_items` reports them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=1):
            hashes, bounds = words(part.column(1), GAP)
            digests = [blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary())], ["item_id", "digest"])

    named = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    told = named.mapInArrow(run, "item_id long, digest binary").distinct()
    return told.join(told.groupBy("digest").agg(F.min("item_id").alias("same_as")), "digest").select("item_id", "same_as")


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", max_edit: float = 0.15, min_words: int = 1, repeats: int = 20, bits: int = 3,
               block_words: int = 1 << 20, seed: int = 11) -> DataFrame:
    """(id, item_id, first_word, n_words, edits) for every document and item that match; the window of fewest edits.

    Items of equal words are sought once, under their least id; `equal_items` names the others.
    """
    named = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    named = named.join(equal_items(items, item_id, item_text).where("item_id = same_as").select(F.col("item_id").alias("item")), "item", "left_semi")
    # A word and its gap take two characters at least.
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // 2 // block_words))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("edits", T.LongType())])
    src = docs.select(id_col, F.col(text_col).alias("_text"))

    def search(block: int) -> DataFrame:
        own = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        hashes, bounds = words(own.column("text").combine_chunks() if own.num_rows else pa.array([], pa.string()), GAP)
        unique: dict[bytes, tuple[int, np.ndarray]] = {}
        for i, a, b in sorted(zip(own.column("item").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()), key=lambda x: (x[0] is None, x[0] or 0)):
            if b - a >= max(1, min_words) and i is not None:
                unique.setdefault(hashes[a:b].tobytes(), (i, hashes[a:b]))
        prepared = Items(list(unique.values()), max_edit, repeats, bits, seed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text=1):
                hits = list(prepared.find(*words(part.column(1), GAP)))
                rows, *rest = zip(*hits) if hits else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)],
                                                 [id_col, "item_id", "first_word", "n_words", "edits"])

        return src.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [search(b) for b in range(blocks)])


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
