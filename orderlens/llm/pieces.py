"""Token ids of whole texts under a public tokenizer, one encoding per distinct word.

The pre-tokenizers used here never join a character with white space after it, so
the tokens of a text are those of its words in order (with the whole run of Unicode
white space before them, where the vocabulary has it). Arrow dictionary-encodes the words of a batch;
only distinct ones reach the tokenizer, and memos are cleared when they grow large.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from orderlens.llm.words import SPACE, unicode_space, word_spans

_MEMO_LIMIT = 300_000


def tiles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Tile codes, distinct tiles, first tile of each row (n + 1 values) and tile end bytes.

    A tile is a whole run of Unicode white space and the word after it, or a row's
    trailing white space; the tiles of a row are exactly its bytes.
    """
    _, ends, _ = word_spans(data, off, unicode_space(data))
    ends = np.union1d(ends, off[1:][off[1:] > off[:-1]])
    bounds = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    first = np.searchsorted(ends, off, side="right")
    return np.asarray(coded.indices), coded.dictionary.to_pylist(), first, ends


class Lengths:
    """Ids of distinct tiles laid end to end, with start and length of each tile."""

    def __init__(self, ids: list) -> None:
        self.length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.fromiter((i for x in ids for i in x), np.uint32, int(self.length.sum()))

    def expand(self, codes: np.ndarray) -> np.ndarray:
        """Ids of a sequence of tiles."""
        n = self.length[codes]
        at = np.repeat(self.start[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at]


_CLASS = np.full(256, 3, np.uint8)  # symbols; 0 white space, 1 letters, 2 digits
_CLASS[SPACE] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_QUOTE, _LESS, _BAR, _LATIN = 0x27, 0x3C, 0x7C, 0xC3
_TIMES, _DIVIDE = 0x97, 0xB7  # after 0xC3, the two signs among the Latin-1 letters


class WordBpe:
    """A ``tokenizers`` BPE vocabulary with word ends that lowers case and drops white space.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``. Words of
    ASCII and composed Latin-1 letters are cut where letters, single digits and
    symbols meet, as the file's pre-tokenizer does. Words with other characters
    or an apostrophe or a control character go whole through the file's own normalizer and
    pre-tokenizer, words holding an added token through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.alphabet = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0]
                         for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])}
        self.memo: dict[bytes, tuple] = {}

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Piece codes, distinct pieces and the first piece of each row (n + 1 values)."""
        starts, ends, _ = word_spans(data, off)
        n = len(data)
        last = np.concatenate([[0], data[:-1]]).astype(np.uint8)
        after_latin = last == _LATIN
        odd = (data >= 0x80) & (data != _LATIN) & ~(after_latin & (data != _TIMES) & (data != _DIVIDE))
        odd |= (data == _QUOTE) | (data == 0x7F) | (data < 0x21) & ~SPACE[data]
        odd |= (data == _BAR) & (last == _LESS)
        seen = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
        whole = seen[ends] > seen[starts]
        step = np.zeros(n + 1, np.int8)
        step[starts[whole]] += 1
        step[ends[whole]] -= 1
        inside = np.cumsum(step[:n], dtype=np.int8).astype(bool)
        kind = _CLASS[data]
        cut = np.empty(n, bool)
        cut[:1] = True
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut &= ~inside
        cut[starts] = True
        solid = kind != 0
        cut &= solid
        lower = data.copy()
        lower[(data >= 0x41) & (data <= 0x5A) & ~inside] += 0x20
        lower[after_latin & (data >= 0x80) & (data <= 0x9E) & (data != _TIMES) & ~inside] += 0x20
        at = np.flatnonzero(cut)
        compact = lower[solid]
        bounds = np.append((np.cumsum(solid) - 1)[at], len(compact)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(compact)])
        coded = column.dictionary_encode()
        return np.asarray(coded.indices), coded.dictionary.to_pylist(), np.searchsorted(at, off)

    def _encode(self, piece: bytes) -> tuple:
        text = piece.decode()
        if text.isascii() and text.isprintable() and "'" not in text and "<|" not in text:
            return tuple([t.id for t in self.model.tokenize(text)])
        if "<|" in text and any(a in piece for a in self.added):
            return tuple(self.tok.encode(text, add_special_tokens=False).ids)
        if all(ord(c) in self.alphabet for c in text if not "a" <= c <= "z"):
            return tuple([t.id for t in self.model.tokenize(text.translate(self.alphabet))])
        parts = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return tuple([t.id for p, _ in parts for t in self.model.tokenize(p)])

    def encode_pieces(self, distinct: list[bytes]) -> Lengths:
        memo = self.memo
        if len(memo) > _MEMO_LIMIT:
            memo.clear()
        out = []
        for piece in distinct:
            ids = memo.get(piece)
            if ids is None:
                ids = memo[piece] = self._encode(piece)
            out.append(ids)
        return Lengths(out)


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """One per worker process, so that its memo serves later tasks too."""
    return WordBpe(path)


class BytePair:
    """A ``tiktoken`` rank file; every token stands for a run of the text's bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.memo: dict[bytes, list] = {}

    def encode_tiles(self, distinct: list[bytes]) -> Lengths:
        if len(self.memo) > _MEMO_LIMIT:
            self.memo.clear()
        out = []
        for tile in distinct:
            ids = self.memo.get(tile)
            if ids is None:
                ids = self.memo[tile] = tuple(self.encoding.encode_ordinary(tile.decode()))
            out.append(ids)
        return Lengths(out)


@lru_cache(maxsize=1)
def byte_pair(path: str, pattern: str) -> BytePair:
    """One per worker process, so that its memo serves later tasks too."""
    return BytePair(path, pattern)
