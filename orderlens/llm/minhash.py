"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

Every document is a weighted set of word 5-shingles. Hashed darts fall into the
regions (element x weight) along a rank axis; each of K coordinates keeps its
earliest dart. Two documents agree in a coordinate with probability equal to
their weighted Jaccard similarity. Bands of coordinates are bucket keys.

Documents with equal shingle sets collapse to one representative first. In each
bucket every member is compared with the bucket's centre by whole shingle sets;
runs of two and three bands form deeper buckets with centres of their own, so
close members of a large bucket meet without all pairs. Buckets whose members
are still apart get new centres, twice. Then every pair that shares a bucket and is
still of two classes is tested: small buckets as rows of pairs, larger ones in
blocks of members, a task for two blocks, where parity sketches drop pairs that
cannot be similar before whole sets are compared. So no two similar documents
that share a bucket stay apart. Rows are never dropped. Components come
from label propagation on tables, not on the driver.

Defined cases: words are runs of Unicode letters and digits in lower case; a text of fewer than five words is one shingle of all its
words; null, empty and wordless texts have no shingles and are each their own
class; repeated rows share a class; ids may repeat or be null, as each row is judged by
itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.common import materialize, row_ranges, text_bytes, with_row_key
from orderlens.llm.words import folded_text, mix, window_hashes, word_hashes, word_spans

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
DEPTHS = (2, 3)
RECENTRED = 2
PAIRED = 16  # buckets up to this size lay out their pairs as rows
BLOCK = 256  # members of a block of a larger bucket
_SKETCH_BITS = 1024
_SLICE_BYTES = 1 << 19
_LOWEST = -4  # darts of ranks under 2^-4 come from one cell
_HIGHEST = 40


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every run of ``width`` words of folded texts (shorter texts: of all their words)."""
    starts, ends, first = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, 0)
    rows = np.repeat(np.arange(len(n)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    hashes = window_hashes(words, width)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        tail = np.array([window_hashes(words[first[r]: first[r + 1]], int(n[r]))[0] for r in short], np.uint64)
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, tail])
    return rows, hashes


def dart_signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """K earliest darts per row (ids; 0 where a row has no element), for sparse weighted rows.

    The plane weight x rank is cut into cells: weight layers [0,1), [1,2), [2,4), ...
    and rank layers [0,2^-4), [2^-4,2^-3), ... A cell's darts are a Poisson number
    from a hash of (element, cell), each with a hashed weight, rank and coordinate;
    darts above the element's weight miss. Rank layers are opened, lowest first, for
    rows that still lack a coordinate, so a row sees the same darts as any other row.
    """
    best_rank = np.full(n_rows * k, np.inf)
    best_id = np.zeros(n_rows * k, np.uint64)
    open_rows = np.zeros(n_rows, bool)
    open_rows[rows[weights > 0]] = True
    for level in range(_LOWEST, _HIGHEST):
        use = open_rows[rows]
        if not use.any():
            break
        r, e, w = rows[use], elements[use], weights[use]
        low, high = (0.0 if level == _LOWEST else 2.0 ** (level - 1)), 2.0 ** level
        layer = 0
        while True:
            bottom, top = (0.0, 1.0) if layer == 0 else (2.0 ** (layer - 1), 2.0 ** layer)
            tall = w > bottom
            if not tall.any():
                break
            rr, ee, ww = r[tall], e[tall], w[tall]
            cell = mix(ee ^ np.uint64(((level + 64) << 8 | layer) * 0x9E3779B97F4A7C15 % (1 << 64)))
            count = _poisson(cell, (high - low) * (top - bottom))
            owner = np.repeat(np.arange(len(rr)), count)
            nth = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
            dart = mix(cell[owner] + (nth + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
            height = bottom + _unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) * (top - bottom)
            hit = height < ww[owner]
            owner, dart = owner[hit], dart[hit]
            rank = low + _unit(mix(dart ^ np.uint64(0x14057B7EF767814F))) * (high - low)
            slot = rr[owner] * k + (mix(dart ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
            order = np.lexsort((rank, slot))
            slot, rank, dart = slot[order], rank[order], dart[order]
            lead = np.ones(len(slot), bool)
            lead[1:] = slot[1:] != slot[:-1]
            slot, rank, dart = slot[lead], rank[lead], dart[lead]
            better = rank < best_rank[slot]
            best_rank[slot[better]] = rank[better]
            best_id[slot[better]] = dart[better]
            layer += 1
        open_rows &= np.isinf(best_rank.reshape(n_rows, k)).any(axis=1)
    return best_id.reshape(n_rows, k)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _poisson(h: np.ndarray, mean: float) -> np.ndarray:
    """A Poisson number with this mean for every hash; large means are sums over equal parts."""
    parts = max(1, int(np.ceil(mean / 16)))
    mean /= parts
    term, terms = np.exp(-mean), []
    for i in range(80):
        terms.append(term)
        term *= mean / (i + 1)
    below = np.cumsum(terms)
    total = np.zeros(len(h), np.int64)
    for part in range(parts):
        h = mix(h ^ np.uint64(0xD6E8FEB86659FD93 + part))
        total += np.searchsorted(below, _unit(h), side="right")
    return total


def document_features(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows_per_band: int = ROWS,
                      width: int = WIDTH) -> DataFrame:
    """``_row`` (a key of the input row), ``_id``, key of the shingle set, its sorted shingles cut to 32 bits, band keys.

    Every shingle weighs 1.
    """
    k = bands * rows_per_band

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = text_bytes(batch.column(2))
            for a, b in row_ranges(off, _SLICE_BYTES):
                rows, hashes = shingles(*folded_text(batch.column(2).slice(a, b - a)), width)
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                lead = np.ones(len(rows), bool)
                lead[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(lead)
                rows, hashes = rows[at], hashes[at]
                darts = dart_signatures(rows, hashes, np.ones(len(rows)), b - a, k)
                keys = np.zeros((b - a, bands), np.uint64)
                for j in range(rows_per_band):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ darts[:, j::rows_per_band])
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
                mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
                size = np.diff(bounds)
                has = size > 0
                set_a = sums[bounds[1:]] - sums[bounds[:-1]]
                set_b = mixed[bounds[1:]] - mixed[bounds[:-1]]
                short = np.unique((rows.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
                cuts = np.searchsorted(short >> np.uint64(32), np.arange(b - a + 1).astype(np.uint64))
                raw = pa.Array.from_buffers(pa.large_binary(), b - a, [
                    None, pa.py_buffer((cuts * 4).astype(np.int64)),
                    pa.py_buffer((short & np.uint64(0xFFFFFFFF)).astype("<u4"))])
                band = pa.ListArray.from_arrays(
                    pa.array(np.append(np.cumsum(has * bands) - has * bands, has.sum() * bands).astype(np.int32)),
                    pa.array(keys[has].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size.astype(np.int64)),
                     pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)),
                     raw.cast(pa.binary()), band],
                    names=["_row", "_id", "_size", "_set_a", "_set_b", "_shingles", "_bands"])

    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                         F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(features, f"_row long, _id {kind}, _size long, _set_a long, _set_b long, "
                                       "_shingles binary, _bands array<long>")


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted shingle sets have at least this Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    joint = len(x) + len(y) - len(np.union1d(x, y))
    return joint >= similarity * (len(x) + len(y) - joint) and joint > 0


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets have at least this Jaccard similarity."""
    left = sets.select(F.col("_rep").alias("a"), F.col("_shingles").alias("_sa"))
    right = sets.select(F.col("_rep").alias("b"), F.col("_shingles").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_sa", "_sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(alike(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), similarity))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                             names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def components(edges: DataFrame, kind: str = "labels") -> DataFrame:
    """Smallest member of each connected component: (node, label), for nodes that have an edge.

    Each round every node takes the smallest label around it, then the label of
    its label, until nothing changes. Tables are written between rounds.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), kind)
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
            F.min("label").alias("near"))
        hop = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = materialize(hop.join(jump, "near", "left").select(
            "node", F.least("near", F.coalesce("far", "near")).alias("label"),
            (F.least("near", F.coalesce("far", "near")) != F.col("label")).alias("moved")), kind)
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the old labels that the links join."""
    old = labels.select("node", "label")
    ends = links.join(old.withColumnRenamed("node", "a").withColumnRenamed("label", "la"), "a", "left").join(
        old.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b", "left")
    ends = materialize(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), "ends")
    joined = components(ends.filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    fresh = ends.select(F.col("a").alias("node"), F.col("la").alias("label")).union(ends.select("b", "lb"))
    every = old.union(fresh).distinct()
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialize(every.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")),
                       "labels")


def _joined_bands(bands: int, depth: int) -> Column:
    """Keys of runs of ``depth`` consecutive bands (round the end)."""
    def key(i: Column) -> Column:
        return F.xxhash64(*[F.get("_bands", (i + d) % bands) for d in range(depth)])

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)


def _pairs_with(members: DataFrame, centre: Column) -> DataFrame:
    """Distinct (smaller, larger) pairs of each bucket's centre with its members."""
    centres = members.groupBy("_band", "_key").agg(centre.alias("_centre"), F.count("*").alias("n")).filter("n > 1")
    centres = materialize(centres.drop("n"), "centres")
    return members.join(centres, ["_band", "_key"]).filter("_rep != _centre").select(
        F.least("_centre", "_rep").alias("a"), F.greatest("_centre", "_rep").alias("b")).distinct()


def _with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    mine = labels.select(F.col("node").alias("_rep"), F.col("label").alias("_label"))
    return members.join(mine, "_rep", "left").withColumn("_label", F.coalesce("_label", "_rep"))


def parity_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parities of the number of elements in each of 1024 cells, as 64-bit words, a row a set.

    Sketches of two sets differ in at most as many bits as the sets have elements not in common.
    """
    out = np.empty((len(sets), _SKETCH_BITS // 8), np.uint8)
    for r, x in enumerate(sets):
        out[r] = np.packbits((np.bincount(x & np.uint32(_SKETCH_BITS - 1), minlength=_SKETCH_BITS) & 1).astype(bool))
    return out.view(np.uint64)


def block_links(labels: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray],
                similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that join the classes of one block with those of the other, or within a single block.

    Every pair of two classes is tested unless links found here already join its classes.
    """
    size = np.array([len(x) for x in sets])
    sketch = parity_sketches(sets)
    left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    single = blocks.min() == blocks.max()
    above: dict[int, int] = {}

    def top(label: int) -> int:
        while label in above:
            label = above[label]
        return label

    out = []
    for x in left:
        ys = right[right > x] if single else right
        ys = ys[labels[ys] != labels[x]]
        differ = np.bitwise_count(sketch[x] ^ sketch[ys]).sum(axis=1, dtype=np.int64)
        total = size[x] + size[ys]
        most = (total - differ) / 2  # elements in common, at most
        for y in ys[most >= similarity * (total - most)]:
            a, b = top(int(labels[x])), top(int(labels[y]))
            if a != b and alike(sets[x], sets[y], similarity):
                above[a] = b
                out.append((int(x), int(y)))
    return out


def rest_links(placed: DataFrame, stored: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """Links between members of one bucket that are of two classes; all such pairs are tested.

    A bucket's members are its largest class and the others, each dealt into blocks; two
    blocks meet unless both are of the largest class, so no task holds a whole bucket.
    """
    by_class = placed.groupBy("_band", "_key", "_label").agg(F.count("*").alias("n"))
    apart = by_class.groupBy("_band", "_key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "_label")).alias("_top"), F.count("*").alias("classes"))
    apart = materialize(apart.filter("classes > 1").select("_band", "_key", "n", "_top"), "apart")
    rest = materialize(placed.join(apart, ["_band", "_key"]), "apart-members")

    small = rest.filter(F.col("n") <= PAIRED)
    x = small.select("_band", "_key", F.col("_rep").alias("a"), F.col("_label").alias("la"))
    y = small.select(F.col("_band").alias("yb"), F.col("_key").alias("yk"), F.col("_rep").alias("b"), F.col("_label").alias("lb"))
    meet = (x["_band"] == y["yb"]) & (x["_key"] == y["yk"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
    pairs = x.join(y, meet).select("a", "b").distinct()
    pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")

    in_top = F.col("_label") == F.col("_top._label")
    n_top = F.ceil(F.col("_top.n") / BLOCK)
    n_other = F.ceil((F.col("n") - F.col("_top.n")) / BLOCK)
    spot = F.xxhash64("_rep", F.lit("block"))
    dealt = rest.filter(F.col("n") > PAIRED).select(
        "_band", "_key", "_rep", "_label", in_top.alias("in_top"), n_top.alias("n_top"), (n_top + n_other).alias("n_blocks"),
        F.when(in_top, F.pmod(spot, n_top)).otherwise(n_top + F.pmod(spot, n_other)).alias("_block"))
    meets = F.sequence(F.when(F.col("in_top"), F.col("n_top")).otherwise(F.lit(0).cast("long")), F.col("n_blocks") - 1)
    rows = dealt.join(stored, "_rep").select("_band", "_key", "_rep", "_label", "_block", "_shingles",
                                             F.explode(meets).alias("_other"))
    rows = rows.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))

    def compare(group: pa.Table) -> pa.Table:
        reps, labels, blocks = (group[c].to_numpy() for c in ("_rep", "_label", "_block"))
        sets = [np.frombuffer(s.as_buffer(), "<u4") for s in group["_shingles"]]
        found = np.array(block_links(labels, blocks, sets, similarity), np.int64).reshape(-1, 2)
        ends = np.sort(reps[found].astype(np.int64), axis=1)
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    in_blocks = rows.groupBy("_band", "_key", "_low", "_high").applyInArrow(compare, "a long, b long")
    return materialize(similar_pairs(pairs, stored, similarity).union(in_blocks).distinct(), "links")


def near_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows_per_band: int,
                 width: int) -> DataFrame:
    """``_row`` (place of the input row), ``_id``, ``_class`` (a row of the class) for every row of ``docs``."""
    features = materialize(document_features(docs, id_col, text_col, bands, rows_per_band, width), "features")
    sets = materialize(
        features.filter("_size > 0").groupBy("_set_a", "_set_b", "_size").agg(
            F.min(F.struct("_row", "_bands")).alias("_first"))
        .select(F.col("_first._row").alias("_rep"), "_set_a", "_set_b", "_size", F.col("_first._bands").alias("_bands")),
        "sets")
    buckets = sets.select("_rep", F.posexplode("_bands").alias("_band", "_key"))
    shared = buckets.groupBy("_band", "_key").agg(F.count("*").alias("n")).filter("n > 1").select("_band", "_key")
    shared = materialize(shared, "shared")
    members = materialize(buckets.join(shared, ["_band", "_key"]), "members")
    involved = materialize(members.select("_rep").distinct(), "involved")
    near = sets.join(involved, "_rep", "left_semi")
    stored = materialize(features.select(F.col("_row").alias("_rep"), "_shingles").join(involved, "_rep", "left_semi"), "shingles")

    deeper = [near.select("_rep", F.posexplode(_joined_bands(bands, depth)).alias("_band", "_key")).withColumn(
        "_band", F.col("_band") + bands * depth) for depth in DEPTHS]
    tried = materialize(_pairs_with(reduce(DataFrame.unionByName, [members, *deeper]), F.min("_rep")), "pairs")
    links = materialize(similar_pairs(tried, stored, similarity), "links")
    labels = components(links)
    for turn in range(RECENTRED):
        placed = _with_labels(members, labels)
        apart = placed.groupBy("_band", "_key").agg(
            F.min("_label").alias("least"), F.max("_label").alias("most"),
            F.min(F.struct(F.xxhash64("_rep", F.lit(turn)).alias("h"), "_rep", "_label")).alias("c")).filter("least < most")
        apart = materialize(apart.select("_band", "_key", F.col("c._rep").alias("_centre"),
                                         F.col("c._label").alias("_of")), "apart")
        pairs = placed.join(apart, ["_band", "_key"]).filter("_label != _of").select(
            F.least("_centre", "_rep").alias("a"), F.greatest("_centre", "_rep").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        links = materialize(similar_pairs(pairs, stored, similarity), "links")
        labels = merged(labels, links)
    labels = merged(labels, rest_links(_with_labels(members, labels), stored, tried, similarity))

    by_set = sets.join(labels.select(F.col("node").alias("_rep"), F.col("label").alias("_l")), "_rep", "left").select(
        "_set_a", "_set_b", "_size", F.coalesce("_l", "_rep").alias("_class"))
    by_set = materialize(by_set, "classes")
    placed = features.select("_row", "_id", "_set_a", "_set_b", "_size").join(by_set, ["_set_a", "_set_b", "_size"], "left")
    return materialize(placed.select("_row", "_id", F.coalesce("_class", "_row").alias("_class")), "placed")


def _judged(docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows_per_band: int,
            width: int) -> DataFrame:
    """Per row of ``docs``: ``_row``, ``_id``, and of its class the first row (``_first``: id, row) and the size ``_n``.

    First is the smallest id, null ids last, of equal ids the first row.
    """
    placed = near_classes(docs, id_col, text_col, similarity, bands, rows_per_band, width)
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    classes = placed.groupBy("_class").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    return placed.join(materialize(classes, "sizes"), "_class", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY, bands: int = BANDS, rows_per_band: int = ROWS,
                    width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: id, class id (smallest id of its class), size of the class, kept.

    Rows are told apart by their place, so ids of any type may repeat or be null;
    exactly one row of each class is kept.
    """
    judged = _judged(docs, id_col, text_col, similarity, bands, rows_per_band, width)
    alone = F.col("_n").isNull()
    return judged.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("_first.id")).alias("class_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("_first.row") == F.col("_row"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of ``docs`` of each class, with its columns (``docs`` must be a stored table)."""
    keyed, row = with_row_key(docs)
    judged = _judged(docs, id_col, text_col, SIMILARITY, BANDS, ROWS, WIDTH)
    drop = judged.filter(F.col("_first.row") != F.col("_row")).select(F.col("_row").alias(row))
    return keyed.join(drop, row, "left_anti").select(*docs.columns)
