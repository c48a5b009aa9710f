"""Benchmark decontamination by greedy string tiling.

Every document's word 5-grams are joined with those of the benchmark items
(seeds). For each (document, item) pair with a seed, greedy string tiling marks
the longest non-overlapping matches first, found by running Karp-Rabin hashes
over unmarked words, down to tiles of five words. The share of the item's words
that tiles cover is its coverage; it does not depend on their order, so
reordered passages count too.

The seed table is broadcast in blocks of items of bounded size; a benchmark
beyond one block is met in several passes over the documents, which is exact at
any size.

Defined cases: words are runs of Unicode letters and digits in lower case; an
item of fewer than five words is matched as one run of all its words; null or
wordless texts match nothing; repeated document rows give a row each, repeated
items (same id) likewise; empty tables give no rows; extra columns are ignored; ids
of documents and items may be of any type.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from orderlens.llm.common import row_ranges, text_bytes, with_row_key
from orderlens.llm.words import folded_text, window_hashes, word_hashes, word_spans

MIN_TILE = 5
COVERAGE = 0.8
BLOCK_BYTES = 16 << 20
_SLICE_BYTES = 1 << 22
_BASE = 0x9E3779B97F4A7C15


def folded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the first word of each row."""
    folded, off = folded_text(column)
    starts, ends, first = word_spans(folded, off)
    return word_hashes(folded, starts, ends), first


def _free_runs(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` words that hold no marked word."""
    if len(marked) < length:
        return np.zeros(0, np.int64)
    seen = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(seen[length:] == seen[:-length])


class RunningHashes:
    """Karp-Rabin hashes of all windows of a word sequence, at the same cost for every length."""

    def __init__(self, words: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> None:
        self.n, self.inverse = len(words), powers[1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[0][: self.n], dtype=np.uint64)])

    def windows(self, length: int) -> np.ndarray:
        n = max(0, self.n - length + 1)
        return (self.sums[length: length + n] - self.sums[:n]) * self.inverse[:n]

    @staticmethod
    def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers of the base and of its inverse modulo 2^64."""
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[:1] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        return both[0], both[1]


def _mark_tiles(item: np.ndarray, text: np.ndarray, marked_a: np.ndarray, marked_b: np.ndarray, ha: np.ndarray,
                hb: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Marks equal windows of ``length`` unmarked words, item starts in order, each with the first text start still free.

    Starts of one hash are a queue; a start that is not free any more never becomes so
    again and leaves it, so a pass takes as many steps as there are windows.
    """
    free_a, free_b = _free_runs(marked_a, length), _free_runs(marked_b, length)
    free_a, free_b = free_a[np.isin(ha[free_a], hb[free_b])], free_b[np.isin(hb[free_b], ha[free_a])]
    queues: dict[int, deque] = {}
    for q, h in zip(free_b.tolist(), hb[free_b].tolist()):
        queues.setdefault(h, deque()).append(q)
    tiles = []
    end = 0
    for p, h in zip(free_a.tolist(), ha[free_a].tolist()):
        if p < end:  # inside the tile just marked
            continue
        queue = queues[h]
        while queue and (marked_b[queue[0]] or marked_b[queue[0] + length - 1]):
            queue.popleft()
        for q in queue:  # the first one, unless different words share a hash
            if not marked_b[q] and not marked_b[q + length - 1] and np.array_equal(item[p: p + length], text[q: q + length]):
                marked_a[p: p + length] = True
                marked_b[q: q + length] = True
                tiles.append((p, q, length))
                end = p + length
                break
    return tiles


def greedy_tiles(item: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, words): longest matches first, each word in one tile at most."""
    min_tile = min(min_tile, len(item))
    marked_a, marked_b = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    if min_tile == 0 or len(text) < min_tile:
        return tiles
    powers = RunningHashes.powers(max(len(item), len(text)))
    hash_a, hash_b = RunningHashes(item, powers), RunningHashes(text, powers)
    high = min(len(item), len(text))
    while high >= min_tile:
        # the longest length that still has a match: matches of a length have matches of all shorter ones
        low, top = min_tile - 1, high
        while low < top:
            mid = (low + top + 1) // 2
            ha, hb = hash_a.windows(mid)[_free_runs(marked_a, mid)], hash_b.windows(mid)[_free_runs(marked_b, mid)]
            low, top = (mid, top) if np.isin(ha, hb).any() else (low, mid - 1)
        if low < min_tile:
            break
        tiles += _mark_tiles(item, text, marked_a, marked_b, hash_a.windows(low), hash_b.windows(low), low)
        high = low - 1
    return tiles


def _near_seeds(seeds: np.ndarray, n_words: int, reach: int) -> np.ndarray:
    """Mask of the words inside a seed window; tiles never leave them."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, seeds, 1)
    np.add.at(step, np.minimum(seeds + reach, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def _block_overlaps(docs: DataFrame, ids: list, texts: list[str], min_tile: int, id_type: str,
                    item_type: T.DataType) -> DataFrame:
    """Overlaps with one block of items; its words and seeds go to every task."""
    spark = docs.sparkSession
    words, first = folded_words(pa.array(texts, pa.string()))
    item_kind = to_arrow_type(item_type)
    per_item = [words[first[i]: first[i + 1]] for i in range(len(ids))]
    widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in sorted({min(min_tile, len(w)) for w in per_item if len(w)}):
        mine = [i for i, w in enumerate(per_item) if min(min_tile, len(w)) == width]
        seeds = [window_hashes(per_item[i], width) for i in mine]
        flat = np.concatenate(seeds)
        owner = np.repeat(np.array(mine), [len(s) for s in seeds])
        order = np.argsort(flat, kind="stable")
        widths[width] = flat[order], owner[order]
    shared = spark.sparkContext.broadcast((per_item, widths))
    keys = pa.array(ids, item_kind)

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, by_width = shared.value
        for batch in batches:
            _, off = text_bytes(batch.column(1))
            rows_out, item_out, covered, total, longest, tiles_n = [], [], [], [], [], []
            for a, b in row_ranges(off, _SLICE_BYTES):
                words, first = folded_words(batch.column(1).slice(a, b - a))
                seeds_of: dict[tuple[int, int], list[int]] = {}
                for width, (hashes, owner) in by_width.items():
                    windows = window_hashes(words, width)
                    lo = np.searchsorted(hashes, windows)
                    hit = np.flatnonzero((lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == windows))
                    row = np.searchsorted(first, hit, side="right") - 1
                    inside = hit + width <= first[row + 1]
                    for p, r in zip(hit[inside].tolist(), row[inside].tolist()):
                        j = lo[p]
                        while j < len(hashes) and hashes[j] == windows[p]:
                            spots = seeds_of.setdefault((r, int(owner[j])), [])
                            if not spots or spots[-1] != p:
                                spots.append(p)
                            j += 1
                for (r, i), spots in seeds_of.items():
                    reach = min(min_tile, len(items[i]))
                    at = np.array(spots) - first[r]
                    # outside the seed windows no tile can lie: keep runs of them, set apart by a stop word
                    near = _near_seeds(at, int(first[r + 1] - first[r]), reach)
                    part = np.where(near, words[first[r]: first[r + 1]], np.uint64(0))
                    keep = near | np.concatenate([[False], near[:-1]])
                    found = greedy_tiles(items[i], part[keep], min_tile)
                    rows_out.append(a + r)
                    item_out.append(i)
                    covered.append(sum(n for _, _, n in found))
                    total.append(len(items[i]))
                    longest.append(max((n for _, _, n in found), default=0))
                    tiles_n.append(len(found))
            n = pa.array(covered, pa.int64()), pa.array(total, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows_out, pa.int64())), keys.take(pa.array(item_out, pa.int64())),
                 n[0], n[1], pa.array(longest, pa.int64()), pa.array(tiles_n, pa.int32())],
                names=["_id", "_item", "covered_words", "item_words", "longest_tile", "n_tiles"])

    return docs.mapInArrow(overlaps, f"_id {id_type}, _item {item_type.simpleString()}, covered_words long, item_words long, "
                                     "longest_tile long, n_tiles int")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE,
                       coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per (document, item) that share a seed: covered words, coverage, contaminated."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    out = None
    ids: list = []
    texts: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal out, ids, texts, size
        part = _block_overlaps(source, ids, texts, min_tile, id_type, items.schema["i"].dataType)
        out = part if out is None else out.unionByName(part)
        ids, texts, size = [], [], 0

    items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(
        F.col(item_text_col).cast("string"), F.lit("")).alias("t")).orderBy("i", "t")
    for row in items.toLocalIterator():  # at most one block of items is on the driver at a time
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"].encode())
        if size >= block_bytes:
            flush()
    if ids or out is None:
        flush()
    share = F.when(F.col("item_words") > 0, F.col("covered_words") / F.col("item_words")).otherwise(F.lit(0.0))
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "covered_words", "item_words",
                      "longest_tile", "n_tiles", share.alias("coverage"), (share >= coverage).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with their columns.

    Judged row by row, whatever the ids: rows are told apart by their place in the
    input, so ``docs`` must be a stored table.
    """
    keyed, row = with_row_key(docs)
    hits = benchmark_overlaps(keyed, benchmark, row, text_col).filter("contaminated").select(row).distinct()
    return keyed.join(hits, row, "left_anti").select(*docs.columns)
