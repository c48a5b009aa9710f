"""Substring dedup with fixed-block anchors.

A repeat is a run of ``window`` words that starts at more than one place of the
corpus. With blocks of b = (window + 1) // 2 words at every multiple of b, each
such run holds a whole block of its text, and the same b words at its other
place. So three passes find all repeats:

1. every rolling run of b words probes the index of blocks by hash; a block found
   at two places or more is an anchor;
2. around anchors, runs of ``window`` words are hashed and counted, which extends
   the hits to the maximal exact repeats;
3. words covered by a repeated run are removed.

Texts are dealt once to batches of bounded size (all passes reuse that shuffle).
Between batches and hash buckets go packed arrays, one row per (batch, bucket):
4 bytes a distinct block-long run, 12 bytes a candidate run, one bit back. A
batch sends a run at most once, with a mark if it has it twice, so a passage in
every document costs one entry per batch. Pass 1 may meet false hits of its
short hashes (they only add candidates); pass 2 takes 96 bits and the bucket, made
of two independent hashes of each word.

Defined cases: words are runs outside 0x20, 0x09-0x0D, compared by their bytes;
null and wordless texts have no words and the hash of the empty text; repeated
rows are copies of each other, so they lose their words if long enough; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.common import shuffle_partitions, text_bytes
from orderlens.llm.words import window_hashes, window_starts, word_hashes, word_spans

WINDOW = 35
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20


_SECOND = 0x6A09E667F3BCC909  # salt of the second hash of a word


def _load(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray], np.ndarray]:
    """Bytes, row offsets, hashes of all words by salt, first word of each row."""
    data, off = text_bytes(batch.column("_text"))
    starts, ends, first = word_spans(data, off)
    return data, off, lambda salt: word_hashes(data, starts, ends, salt), first


def _bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, the lower 32 bits of the hash in the lower half."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _block_runs(words: np.ndarray, first: np.ndarray, block: int, buckets: int):
    """Positions of the rolling runs, their distinct keys, inverse, counts."""
    at = np.flatnonzero(window_starts(first, block))
    keys = _bucketed(window_hashes(words, block)[at], buckets)
    return at, *np.unique(keys, return_inverse=True, return_counts=True)


def _long_runs(words: np.ndarray, second: np.ndarray, first: np.ndarray, window: int, block: int, buckets: int,
               hits: np.ndarray, at: np.ndarray):
    """Positions of the long runs that hold a hit, their distinct (key, more) pairs, inverse, counts.

    ``words`` and ``second`` are two independent hashes of each word; a run's key comes from both.
    """
    n = len(words)
    seen = np.zeros(n + 1, np.int64)
    seen[at[hits] + 1] = 1
    seen = np.cumsum(seen)
    ok = window_starts(first, window)
    start = np.arange(len(ok))
    ok &= seen[start + window - block + 1] > seen[start]
    pos = np.flatnonzero(ok)
    a = window_hashes(words, window)[pos]
    b = window_hashes(second, window)[pos]
    pairs = np.empty(len(pos), [("bucket", "<u4"), ("a", "<u8"), ("b", "<u4")])
    pairs["bucket"] = a % np.uint64(buckets)
    pairs["a"] = a
    pairs["b"] = b >> np.uint64(32)
    order = np.lexsort((pairs["b"], pairs["a"], pairs["bucket"]))
    lead = np.ones(len(pos), bool)
    lead[1:] = pairs[order][1:] != pairs[order][:-1]
    inverse = np.empty(len(pos), np.int64)
    inverse[order] = np.cumsum(lead) - 1
    uniq = pairs[order][lead]
    return pos, uniq, inverse, np.bincount(inverse, minlength=len(uniq))


def _rows(batch_id: int, bounds: np.ndarray, **columns: list[np.ndarray]) -> pa.Table:
    """One row per bucket that has entries; each column is packed bytes of the bucket's part."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = {"bucket": pa.array(full, pa.int32()), "batch": pa.array(np.full(len(full), batch_id), pa.int64())}
    for name, values in columns.items():
        parts = [values[bounds[k]: bounds[k + 1]] for k in full]
        out[name] = pa.array([(np.packbits(p) if p.dtype == bool else p).tobytes() for p in parts], pa.binary())
    return pa.table(out)


def _answer(replies: pa.Table, bounds: np.ndarray) -> np.ndarray:
    """The reply bits of all buckets, in the order of the batch's distinct keys."""
    out = np.zeros(int(bounds[-1]), bool)
    for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        n = int(bounds[bucket + 1] - bounds[bucket])
        out[bounds[bucket]: bounds[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def _bits(table: pa.Table, name: str, counts: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                           for b, n in zip(table.column(name).to_pylist(), counts)])


def _reply(table: pa.Table, yes: np.ndarray, counts: list[int]) -> pa.Table:
    ends = np.cumsum(counts)
    keep, bits = [], []
    for i, (e, n) in enumerate(zip(ends, counts)):
        part = yes[e - n: e]
        if part.any():
            keep.append(i)
            bits.append(np.packbits(part).tobytes())
    picked = table.select(["batch", "bucket"]).take(pa.array(keep, pa.int64()))
    return picked.append_column("bits", pa.array(bits, pa.binary()))


def _repeated(keys: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct ones of all keys of a bucket: inverse, and whether they occur at two places or more."""
    uniq, inverse = np.unique(keys, return_inverse=True)
    times = np.bincount(inverse, minlength=len(uniq)) + np.bincount(inverse, weights=twice, minlength=len(uniq))
    return inverse, times >= 2


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    batch_bytes: int = BATCH_BYTES, keep_text: bool = False) -> DataFrame:
    """A row per document: words, removed words, sha256 of the kept words (and the kept text if asked for)."""
    block = (window + 1) // 2
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    # buckets grow with the data, so that none holds more than about BUCKET_BYTES of texts' hashes
    buckets = max(4 * shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    # by the row's place, so equal rows spread
    dealt = source.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)))

    def probe(batch: pa.Table) -> pa.Table:
        _, _, hashed, first = _load(batch)
        at, uniq, inverse, counts = _block_runs(hashed(0), first, block, buckets)
        row_start = np.repeat(first[:-1], np.diff(first))
        aligned = np.zeros(len(uniq), bool)
        aligned[inverse[(at - row_start[at]) % block == 0]] = True
        bounds = np.searchsorted(uniq, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        return _rows(batch.column("batch")[0].as_py(), bounds, probes=uniq.astype("<u4"),
                     twice=counts > 1, blocks=aligned)

    def anchors(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, "<u4") for b in table.column("probes").to_pylist()]
        counts = [len(p) for p in parts]
        inverse, many = _repeated(np.concatenate(parts), _bits(table, "twice", counts))
        indexed = np.bincount(inverse, weights=_bits(table, "blocks", counts)) > 0
        return _reply(table, (many & indexed)[inverse], counts)

    def extend(batch: pa.Table, replies: pa.Table) -> pa.Table:
        pos, uniq, inverse, counts, bounds = _candidates(batch, replies)
        if not len(pos):
            return _rows(0, np.zeros(buckets + 1, np.int64), keys=np.zeros(0, "u1"), twice=np.zeros(0, bool))
        packed = np.empty(len(uniq), [("a", "<u8"), ("b", "<u4")])
        packed["a"], packed["b"] = uniq["a"], uniq["b"]
        return _rows(batch.column("batch")[0].as_py(), bounds, keys=packed, twice=counts > 1)

    def repeats(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, [("a", "<u8"), ("b", "<u4")]) for b in table.column("keys").to_pylist()]
        counts = [len(p) for p in parts]
        inverse, many = _repeated(np.concatenate(parts), _bits(table, "twice", counts))
        return _reply(table, many[inverse], counts)

    def _candidates(batch: pa.Table, replies: pa.Table):
        _, _, hashed, first = _load(batch)
        words = hashed(0)
        at, uniq, inverse, _ = _block_runs(words, first, block, buckets)
        bounds = np.searchsorted(uniq, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        hits = _answer(replies, bounds)[inverse] if len(at) else np.zeros(0, bool)
        pos, pairs, back, counts = _long_runs(words, hashed(_SECOND), first, window, block, buckets, hits, at)
        return pos, pairs, back, counts, np.searchsorted(pairs["bucket"], np.arange(buckets + 1))

    def remove(batch: pa.Table, replies: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in out_schema(batch)})
        short = replies.filter(pa.compute.equal(replies.column("pass"), 1))
        final = replies.filter(pa.compute.equal(replies.column("pass"), 2))
        data, off = text_bytes(batch.column("_text"))
        _, _, first = word_spans(data, off)
        covered = np.zeros(int(first[-1]), bool)
        if final.num_rows:
            pos, _, inverse, _, bounds = _candidates(batch, short)
            starts = pos[_answer(final, bounds)[inverse]]
            step = np.zeros(int(first[-1]) + 1, np.int32)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + window, -1)
            covered = np.cumsum(step[:-1]) > 0
        n_words = np.diff(first)
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), first[:-1]) * (n_words > 0)
        shas, texts = [], []
        for r in range(batch.num_rows):
            words = data[off[r]: off[r + 1]].tobytes().split()
            if removed[r]:
                words = [w for w, c in zip(words, covered[first[r]: first[r + 1]].tolist()) if not c]
            kept = b" ".join(words)
            shas.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                texts.append(kept.decode())
        out = [batch.column("_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
               pa.array(shas, pa.string())] + ([pa.array(texts, pa.string())] if keep_text else [])
        return pa.Table.from_arrays(out, names=[f.name for f in out_schema(batch)])

    def out_schema(batch: pa.Table) -> list[pa.Field]:
        fields = [pa.field("_id", batch.schema.field("_id").type), pa.field("n_words", pa.int64()),
                  pa.field("n_removed", pa.int64()), pa.field("kept_sha256", pa.string())]
        return fields + ([pa.field("kept_text", pa.string())] if keep_text else [])

    reply = "batch long, bucket int, bits binary"
    by_batch = dealt.groupBy("batch")
    probes = by_batch.applyInArrow(probe, "bucket int, batch long, probes binary, twice binary, blocks binary")
    anchor_bits = probes.groupBy("bucket").applyInArrow(anchors, reply)
    runs = by_batch.cogroup(anchor_bits.groupBy("batch")).applyInArrow(
        extend, "bucket int, batch long, keys binary, twice binary")
    repeat_bits = runs.groupBy("bucket").applyInArrow(repeats, reply)
    both = anchor_bits.withColumn("pass", F.lit(1)).unionByName(repeat_bits.withColumn("pass", F.lit(2)))
    out = by_batch.cogroup(both.groupBy("batch")).applyInArrow(
        remove, f"_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
    return out.withColumnRenamed("_id", id_col)
