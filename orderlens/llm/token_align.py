"""Alignment of two tokenizers over the same texts by lockstep merging.

Tokenizer A is a byte-level BPE (``tokenizers`` file) over a space and the text, B a
``sentencepiece`` BPE that adds this space itself. Both cut at white space, so distinct
tiles (white space and the word after) are encoded once. The tokens of a batch of
documents are laid end to end; documents are cut into *lanes* where a blank starts a tile
of both. One state vector holds the next A and the next B token of every lane: each step
links the two tokens of all lanes at once, marks a cut where both end at the same byte,
moves on whichever ends first (both at a cut), and drops finished lanes.

A pair of ids counts the documents that hold it linked. Batches send their distinct pairs
with local counts, one row per pair; totals and the highest total of each A id come back,
and the batch's documents, written in between with their pairs packed, are summed up.

Defined cases: texts that are null, empty, or whose tokens' bytes differ from space+text
(a literal U+2581, for one) have no tokens: zeros, and '' for the groups; rows with equal
ids or texts are documents of their own; an empty table gives no rows; other columns are
ignored. Memory holds one batch, or one document that is longer than a batch; a text
without any blank is one lane.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.common import materialize, row_ranges, text_bytes
from orderlens.llm.words import unicode_space

BATCH_BYTES = 2 << 20
LANE_BYTES = 512
_MEMO_LIMIT = 600_000
_BLANK = 0x20
_B_BITS = 16


class _Tiles:
    """Ids of distinct tiles, remembered in one array; none for tiles whose token bytes are not the tile."""

    token: list[bytes]

    def __init__(self) -> None:
        self.width = np.array([len(t) for t in self.token], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.wrong, self.flat = np.zeros(0, bool), np.zeros(0, np.int32)

    def _learn(self, new: list[bytes]) -> None:
        ids = self._ids(new)
        for k, (tile, x) in enumerate(zip(new, ids)):
            if b"".join([self.token[i] for i in x]) != tile:
                ids[k] = None
        known = len(self.number)
        self.number.update(zip(new, range(known, known + len(new))))
        length = np.array([len(x or ()) for x in ids], np.int64)
        self.start = np.append(self.start, np.cumsum(length) - length + len(self.flat))
        self.length = np.append(self.length, length)
        self.wrong = np.append(self.wrong, np.array([x is None for x in ids], bool))
        self.flat = np.append(self.flat, np.array([i for x in ids if x for i in x], np.int32))

    def encode(self, codes: np.ndarray, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of tiles, and which of the tiles are not equal to their tokens."""
        if len(self.number) > _MEMO_LIMIT:
            self._forget()
        new = [t for t in distinct if t not in self.number]
        if new:
            self._learn(new)
        tile = np.array([self.number[t] for t in distinct], np.int64)[codes]
        n = self.length[tile]
        at = np.repeat(self.start[tile] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at], self.wrong[tile]


class ByteLevel(_Tiles):
    """A byte-level BPE of the ``tokenizers`` library; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # printable bytes stand for themselves, the others for the code points from 256 on, in order
        plain = [b for b in range(256) if chr(b).isprintable() and b != _BLANK and b != 0xAD]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in byte_of.values())}
        if set(byte_of) != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError(f"{path}: not the byte-level alphabet")
        self.token = [b""] * self.tok.get_vocab_size()
        for entry, i in self.tok.get_vocab().items():
            if all(c in byte_of for c in entry):
                self.token[i] = bytes([byte_of[c] for c in entry])
        super().__init__()

    def _ids(self, distinct: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([t.decode() for t in distinct], add_special_tokens=False)]


class Pieces(_Tiles):
    """A ``sentencepiece`` BPE with byte fallback that writes a blank as U+2581 and adds one in front."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in e.lstrip("▁") for e in entries):
            raise ValueError(f"{path}: a piece reaches over a blank, so texts cannot be cut there")
        self.token = [bytes([int(e[1:-1], 16)]) if sp.is_byte(i) else e.replace("▁", " ").encode()
                      for i, e in enumerate(entries)]
        self.blank = sp.piece_to_id("▁")
        super().__init__()

    def _ids(self, distinct: list[bytes]) -> list[list[int]]:
        # every tile starts with a blank, which the model adds; a blank alone it would not
        return [ids if len(t) > 1 else [self.blank]
                for t, ids in zip(distinct, self.sp.encode([t[1:].decode() for t in distinct], num_threads=1))]


@lru_cache(maxsize=2)
def tokenizer(kind: type, path: str) -> _Tiles:
    """One per worker process, so that its memo serves later tasks too."""
    return kind(path)


def tiles(data: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes and distinct values of tiles, and their start bytes: runs of ``space`` with what follows, by row."""
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[off[:-1][off[:-1] < len(data)]] = True
    bounds = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist(), bounds[:-1]


def tokens(tok: _Tiles, data: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their end bytes, and a mask of rows that their tokens do not spell."""
    codes, distinct, starts = tiles(data, off, space)
    ids, wrong = tok.encode(codes, distinct)
    first = np.searchsorted(starts, off)
    seen = np.concatenate([[0], np.cumsum(wrong)])
    return ids, np.cumsum(tok.width[ids]), seen[first[1:]] > seen[first[:-1]]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A index, B index) in order, and which of them end a group.

    ``end_a`` and ``end_b`` are end bytes of the tokens laid end to end; ``lanes`` are end
    bytes, the last one included, at which tokens of both end.
    """
    stop = np.searchsorted(end_a, lanes, side="left") + 1
    a = np.concatenate([[0], stop[:-1]])
    b = np.concatenate([[0], np.searchsorted(end_b, lanes, side="left")[:-1] + 1])
    # a link's place: both indices only grow along the text, by one or two a step
    size = len(end_a) + len(end_b)
    link_a, link_cut = np.full(size, -1, np.int64), np.zeros(size, bool)
    while len(a):
        ua, ub = end_a[a], end_b[b]
        at = a + b
        link_a[at] = a
        link_cut[at] = ua == ub
        a = a + (ua <= ub)
        b = b + (ub <= ua)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    at = np.flatnonzero(link_a >= 0)
    return link_a[at], at - link_a[at], link_cut[at]


class _Texts:
    """Decimal texts of ids with the sign that follows them."""

    def __init__(self, n: int) -> None:
        self.plain = np.array([str(i) for i in range(n)], object)
        self.comma, self.bar, self.semicolon = self.plain + ",", self.plain + "|", self.plain + ";"


@lru_cache(maxsize=2)
def _texts(n: int) -> _Texts:
    return _Texts(n)


def _group_texts(ids_a, ids_b, last_a, last_b, vocab: tuple[int, int]) -> np.ndarray:
    """The parts of ``a1,a2|b1;a3|b2,b3`` for all tokens, in order (a text's last part ends in ``;``)."""
    ta, tb = _texts(vocab[0]), _texts(vocab[1])
    group_a = np.concatenate([[0], np.cumsum(last_a)[:-1]]) if len(last_a) else np.zeros(0, np.int64)
    group_b = np.concatenate([[0], np.cumsum(last_b)[:-1]]) if len(last_b) else np.zeros(0, np.int64)
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    before_b = np.concatenate([[0], ends_b])
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[np.arange(len(ids_a)) + before_b[group_a]] = np.where(last_a, ta.bar[ids_a], ta.comma[ids_a])
    out[np.arange(len(ids_b)) + ends_a[group_b]] = np.where(last_b, tb.semicolon[ids_b], tb.comma[ids_b])
    return out


def _small(values: np.ndarray) -> bytes:
    """Packed as 2 or 4 bytes a value; the first byte says which."""
    width = 2 if not len(values) or values.max() < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


_DOC = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
        "pairs": pa.binary(), "times": pa.binary()}


def align_batch(texts: pa.Array, a: _Tiles, b: _Tiles) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns per text, the batch's distinct pairs (A id << 16 | B id) and in how many texts each is.

    ``pairs`` of a text are indices into the distinct pairs, ``times`` how often each is linked.
    """
    raw, off = text_bytes(texts)
    n = len(off) - 1
    # a blank before each text, none for empty ones
    sizes = np.diff(off) + (np.diff(off) > 0)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.full(int(begin[-1]), _BLANK, np.uint8)
    data[np.arange(len(raw)) + np.repeat(begin[1:] - off[1:], np.diff(off))] = raw
    space, blank = unicode_space(data), data == _BLANK
    ids_a, ends_a, bad_a = tokens(a, data, begin, space)
    ids_b, ends_b, bad_b = tokens(b, data, begin, blank)
    bad = bad_a | bad_b
    if bad.any():  # their tokens do not cover their bytes: leave them out and begin again
        keep = pa.array(~bad)
        return align_batch(pc.if_else(keep, texts, pa.scalar(None, texts.type)), a, b)
    # a white space run that starts with a blank starts a tile of both: lanes end there, or with the text
    lane = np.zeros(len(data) + 1, bool)
    lane[1:-1] = blank[1:] & ~space[:-1]
    shared = np.flatnonzero(lane)
    far = np.diff(shared // LANE_BYTES, prepend=0) > 0
    lane[shared[~far]] = False
    lane[begin[1:][sizes > 0]] = True
    link_a, link_b, cut = lockstep(ends_a, ends_b, np.flatnonzero(lane))
    first_a = np.searchsorted(ends_a, begin, side="right")
    first_b = np.searchsorted(ends_b, begin, side="right")
    # an empty text starts at the token of the next one, which comes later and owns it
    doc = np.searchsorted(first_a, link_a, side="right") - 1
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[link_a[cut]] = True
    last_b[link_b[cut]] = True
    parts = _group_texts(ids_a, ids_b, last_a, last_b, (len(a.token), len(b.token)))
    shas = [hashlib.sha256("".join(parts[s:e])[:-1].encode()).hexdigest() if e > s else ""
            for s, e in zip((first_a + first_b)[:-1].tolist(), (first_a + first_b)[1:].tolist())]
    key = ids_a[link_a].astype(np.int64) << _B_BITS | ids_b[link_b]
    in_doc, times = np.unique(doc << 32 | key, return_counts=True)
    doc_of, key_of = in_doc >> 32, in_doc & 0xFFFFFFFF
    keys, index, counts = np.unique(key_of, return_inverse=True, return_counts=True)
    bounds = np.searchsorted(doc_of, np.arange(n + 1))
    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return {
        "n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": np.bincount(doc[cut], minlength=n),
        "n_links": np.bincount(doc, minlength=n), "groups_sha256": shas,
        "pairs": [_small(index[s:e]) for s, e in spans], "times": [_small(times[s:e]) for s, e in spans],
    }, keys, counts


def _aligned(source: DataFrame, path_a: str, path_b: str, batch_bytes: int) -> DataFrame:
    """A row per document (``keys`` null) and one per batch (its distinct pairs and their local counts)."""
    kind = source.schema["_id"].dataType

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer(ByteLevel, path_a), tokenizer(Pieces, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, off = text_bytes(batch.column("_text"))
            for s, e in row_ranges(off, batch_bytes):
                part = batch.slice(s, e - s)
                docs, keys, counts = align_batch(part.column("_text"), a, b)
                rows = e - s
                columns = {"_batch": pa.array(np.full(rows + 1, number)),
                           "_id": pa.concat_arrays([part.column("_id"), pa.nulls(1, part.column("_id").type)])}
                for name, t in _DOC.items():
                    columns[name] = pa.concat_arrays([pa.array(docs[name], t), pa.nulls(1, t)])
                for name, values in (("keys", keys), ("counts", counts)):
                    ends = pa.array([0] * (rows + 1) + [len(values)], pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(values, pa.int64()))
                    columns[name] = pc.if_else(pa.array([False] * rows + [True]), lists, pa.scalar(None, lists.type))
                yield pa.RecordBatch.from_pydict(columns)
                number += 1

    return source.mapInArrow(align, (
        f"_batch long, _id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs binary, times binary, keys array<long>, counts array<long>"))


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batches' pairs, and each pair's documents with whether no pair of its A id has more."""
    local = aligned.filter(F.col("keys").isNotNull()).select("_batch", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "p"))
    local = local.select("_batch", "at", F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    total = local.groupBy("key").agg(F.sum("n").alias("docs")).withColumn("a", F.shiftright("key", _B_BITS))
    # at most a row per entry of the vocabulary
    highest = total.groupBy(F.col("a").alias("best_a")).agg(F.max("docs").alias("best"))
    total = total.join(F.broadcast(highest), F.col("a") == F.col("best_a"))
    return local, total.select("key", "docs", (F.col("docs") == F.col("best")).alias("is_best"))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A row per document: tokens, groups, links, links with a best pair, sum of the pairs' counts, digest of the groups."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    aligned = materialize(_aligned(source, path_a, path_b, batch_bytes), "token-align")
    local, total = pair_counts(aligned)
    total = total.withColumnRenamed("key", "total_key")
    replies = local.join(total, F.col("key") == F.col("total_key")).select(F.col("_batch").alias("_to"), "at", "docs", "is_best")
    rows = aligned.filter(F.col("keys").isNull()).drop("keys", "counts")

    def sums(part: pa.Table, reply: pa.Table) -> pa.Table:
        at = reply.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at] = reply.column("docs").to_numpy()
        best[at] = reply.column("is_best").to_numpy()
        n_best, count_sum = [], []
        for pairs, times in zip(part.column("pairs").to_pylist(), part.column("times").to_pylist()):
            pairs, times = _wide(pairs), _wide(times)
            n_best.append(int(best[pairs] @ times))
            count_sum.append(int(count[pairs] @ times))
        out = part.select(["_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return out.append_column("groups_sha256", part.column("groups_sha256"))

    out = rows.groupBy("_batch").cogroup(replies.groupBy("_to")).applyInArrow(
        sums, f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("_id", id_col)
