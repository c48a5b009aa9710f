"""Token counts of sections by offset-mapped attribution.

A document is encoded once and whole. Every token stands for a run of the text's
bytes, so the tokens' spans follow from their widths; sections are spans too
(lines by default: each keeps its line feed). Spans are joined as intervals, and
a token that crosses a boundary goes by an explicit rule: ``first`` (default) or
``last`` gives it to the section of its first or last byte, ``most`` to the section
with most of its bytes (ties: the earlier). Every token counts exactly once, so a
document's sections add up to its tokens.

Defined cases: a null or empty text has one section without tokens; a section may
be empty of tokens if its bytes belong to tokens of its neighbours; repeated rows
and null ids give rows of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.common import row_ranges, text_bytes
from orderlens.llm.pieces import byte_pair, tiles

_SLICE_BYTES = 1 << 22
RULES = ("first", "last", "most")


def section_of(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Section of every token span; ``bounds`` are the sorted section starts (the first is 0)."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "last":
        return last
    out = first.copy()
    stop = np.append(bounds[1:], np.iinfo(np.int64).max)
    for i in np.flatnonzero(last > first):
        parts = range(first[i], last[i] + 1)
        size = [min(ends[i], stop[k]) - max(starts[i], bounds[k]) for k in parts]
        out[i] = parts[int(np.argmax(size))]
    return out


def section_token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                         text_col: str = "text", rule: str = "first") -> DataFrame:
    """A row per document and line: section, start and length in bytes, tokens, tokens across its start."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pair(ranks_path, pattern)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for a, b in row_ranges(off, _SLICE_BYTES):
                codes, distinct, _, _ = tiles(data[off[a]: off[b]], off[a: b + 1] - off[a])
                ids = encoder.encode_tiles(distinct).expand(codes)
                ends = np.cumsum(encoder.width[ids])
                starts = ends - encoder.width[ids]
                part = data[off[a]: off[b]]
                row_start = off[a: b + 1] - off[a]
                # a line starts at each row start and after each line feed inside a row
                after = np.flatnonzero(part == 0x0A) + 1
                after = after[~np.isin(after, row_start)]
                bounds = np.concatenate([row_start[:-1], after])
                owner = np.concatenate([np.arange(b - a), np.searchsorted(row_start, after, side="right") - 1])
                order = np.lexsort((bounds, owner))
                bounds, owner = bounds[order], owner[order]
                size = np.diff(np.append(bounds, len(part)))
                real = np.flatnonzero(size > 0)  # rows without text hold no byte
                mine = real[section_of(starts, ends, bounds[real], rule)] if len(real) else np.zeros(0, np.int64)
                tokens = np.bincount(mine, minlength=len(bounds))
                opens = np.zeros(len(bounds), np.int64)
                if len(real) and len(starts):
                    at = np.searchsorted(starts, bounds, side="right") - 1
                    crossed = (at >= 0) & (starts[at] < bounds) & (ends[at] > bounds)
                    opens = crossed.astype(np.int64)
                lead = np.searchsorted(owner, np.arange(b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + owner)), pa.array(np.arange(len(owner)) - lead[owner], pa.int64()),
                     pa.array(bounds - row_start[owner], pa.int64()), pa.array(size, pa.int64()),
                     pa.array(tokens, pa.int64()), pa.array(opens, pa.int64())],
                    names=["_id", "section", "start_byte", "n_bytes", "n_tokens", "n_crossing"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    out = source.mapInArrow(count, f"_id {kind}, section long, start_byte long, n_bytes long, n_tokens long, "
                                   "n_crossing long")
    return out.withColumnRenamed("_id", id_col)
