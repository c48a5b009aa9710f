"""Round 5: the memory that a slice of texts takes in a Python worker."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from orderlens.llm import minhash, packing, quality
from orderlens.llm.common import row_ranges, text_bytes


def _batch() -> pa.Array:
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 4000)])
    return pa.array([" ".join(words[rng.integers(0, 4000, 350)]) for _ in range(2500)])


def _peak_mb(step, texts: pa.Array, slice_bytes: int) -> tuple[float, np.ndarray]:
    data, off = text_bytes(texts)
    tracemalloc.start()
    out = [step(texts, data, off, a, b) for a, b in row_ranges(off, slice_bytes)]
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return peak, np.concatenate(out)


def _score(texts, data, off, a, b):
    rng = np.random.default_rng(1)
    weight = rng.normal(size=quality.DIMENSIONS)
    return quality.QualityModel(weight, weight ** 2, 1.0, 0.0).scores(data[off[a]: off[b]], off[a: b + 1] - off[a])


def _darts(texts, data, off, a, b):
    rows, hashes = minhash.shingles(*minhash.folded_text(texts.slice(a, b - a)))
    return minhash.dart_signatures(rows, hashes, np.ones(len(rows)), b - a, minhash.BANDS * minhash.ROWS)


def _ids(texts, data, off, a, b):
    bpe = packing.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    codes, distinct, _ = bpe.pieces(data[off[a]: off[b]], off[a: b + 1] - off[a])
    return bpe.encode_pieces(distinct).expand(codes)


def test_slices_stay_small_and_give_the_same_rows():
    texts = _batch()
    _ids(texts, *text_bytes(texts), 0, len(texts))  # the tokenizer and its memo are there
    for step, module, limit in ((_score, quality, 60), (_darts, minhash, 45), (_ids, packing, 60)):
        peak, rows = _peak_mb(step, texts, module._SLICE_BYTES)
        assert peak < limit, (module.__name__, peak)
        whole = _peak_mb(step, texts, 1 << 21)[1]
        assert np.array_equal(rows, whole)
