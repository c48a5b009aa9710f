"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document is encoded whole and closed by an end id; documents longer than
a sequence are cut into full pieces and a rest. Pieces are dealt by hash to
groups of bounded size, and each group is packed by bounded-space online
best-fit: a fixed number of open bins, a bitset over their free space finds the
tightest bin that holds a piece, and when all bins are taken the fullest closes
first. Only lengths and checksums are shuffled, never ids or texts.

Defined cases: a null or empty text is the end id alone; null ids and repeated
rows are packed like any row; an empty table gives no rows; other input columns
are ignored. Group membership and order depend on the rows alone, so a task that
is run again packs alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.common import row_ranges, text_bytes
from orderlens.llm.pieces import word_bpe

MAX_LENGTH = 4096
END_ID = 1
OPEN_BINS = 1024
GROUP_ROWS = 8192
_SLICE_BYTES = 1 << 20

PIECES = "_id {id}, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by free space; a big integer is the bitset of free spaces in use."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.used = 0
        self.count = 0
        self.made = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.used &= ~(1 << free)
        self.count -= 1
        return bin_id

    def _put(self, bin_id: int, free: int) -> None:
        if free:
            self.by_free[free].append(bin_id)
            self.used |= 1 << free
            self.count += 1

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``length`` ids."""
        fits = self.used >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count >= self.limit:
                self._take((self.used & -self.used).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.made
            self.made += 1
        self._put(bin_id, free - length)
        return bin_id, self.capacity - free


def document_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                    max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: ``_id``, piece, start, length, ids_crc32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            owner, piece, start, length, crc = [], [], [], [], []
            for a, b in row_ranges(off, _SLICE_BYTES):
                codes, distinct, first = bpe.pieces(data[off[a]: off[b]], off[a: b + 1] - off[a])
                table = bpe.encode_pieces(distinct)
                ids = table.expand(codes)
                bounds = np.concatenate([[0], np.cumsum(table.length[codes])])[first]
                for r in range(a, b):
                    row = np.append(ids[bounds[r - a]: bounds[r - a + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(row), max_length)):
                        part = row[at: at + max_length]
                        owner.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(encode, PIECES.format(id=source.schema["_id"].dataType.simpleString()))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     max_length: int = MAX_LENGTH, end_id: int = END_ID,
                     open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces with the sequence and the offset each one takes."""
    groups = max(1, -(-docs.count() // group_rows))
    pieces = document_pieces(docs, tokenizer_path, id_col, text_col, max_length, end_id)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32", "length"), F.lit(groups)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "_id", "piece"], ascending=[False, True, True, True])
        bins = OpenBins(max_length, open_bins)
        placed = np.array([bins.place(n) for n in rows["length"].tolist()], np.int64).reshape(-1, 2)
        base = int(rows["_group"].iloc[0]) << 32
        return rows.drop(columns="_group").assign(sequence_id=base + placed[:, 0], offset=placed[:, 1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    packed = dealt.groupBy("_group").applyInPandas(pack, schema + ", sequence_id long, offset long")
    return packed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
