"""Language identification: script ranges, word scores, Viterbi with a switching penalty.

Training counts, over the labelled rows of smallest hash of each language, the letter 1- to
3-grams of words per language and which scripts (ranges of code points) each
language writes. Scripts narrow each word's candidates: languages that do not write
its scripts are not scored but stand at a fixed value under any score. For the others
a word's score is its smoothed log probability. Viterbi
over the words, with a fixed penalty for each change, labels spans of
mixed-language text; a document's language is the one whose spans have the most
letters, its score their share weighed by how far the scores stand apart.

A document whose best single language cannot be beaten by any span (the largest
gain of any other language over any run of words is under one penalty) keeps one
label without the recursion; the outcome is the same.

Defined cases: a word is a run outside ASCII white space; words without letters
take no part; a null text or one without a letter is ``und`` with score 0; null
labels are not learnt; without any label every text is ``und``; of repeated
rows one is learnt from; ties go to the first language in sorted order;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.functions.aggregates import values_at_ranks
from orderlens.llm.common import held_out, materialize, row_ranges, text_bytes
from orderlens.llm.words import mix, word_spans

SAMPLE_PER_LANGUAGE = 2000
SWITCH_PENALTY = 12.0
GRAM_SLOTS = 1 << 16
_FAR = -30.0  # score of a word for a language that does not write its script; no gram is as unlikely
_SLICE_BYTES = 1 << 23

# First code points of the script ranges told apart
SCRIPT_STARTS = [0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0,
                 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3400, 0xA000, 0xAC00,
                 0xD7B0, 0xF900, 0xFB00, 0x20000]
# ranges that hold letters of the Latin script count as one script
_SAME_SCRIPT = {14: 0, 15: 1}


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case (where that is one character), its script."""
    chars = [chr(c) for c in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
    lower = np.arange(len(chars), dtype=np.int64)
    for c in np.flatnonzero(letter):
        low = chars[c].lower()
        lower[c] = ord(low) if len(low) == 1 else c
    script = np.searchsorted(SCRIPT_STARTS, np.arange(len(chars)), side="right") - 1
    for k, same in _SAME_SCRIPT.items():
        script[script == k] = same
    return letter, lower, script


def word_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all words and the word of each, and for each word the bit set of its scripts."""
    letter, lower, script = _code_points()
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    use = letter[points]
    points, owner = points[use], owner[use]
    scripts = np.zeros(len(words), np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(first):
        scripts[owner[first]] = np.bitwise_or.reduceat(np.int64(1) << script[points], first)
    return lower[points], owner, scripts


def letter_grams(points: np.ndarray, owner: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and slot of every 1- to 3-gram of each word's letters, framed by blanks."""
    count = np.bincount(owner, minlength=n_words)
    framed = np.full(len(points) + 2 * n_words, 0x20, np.uint64)
    framed[np.arange(len(points)) + 2 * owner + 1] = points.astype(np.uint64)
    owner = np.repeat(np.arange(n_words), count + 2)
    word, slot = [], []
    for n in (1, 2, 3):
        m = max(0, len(framed) - n + 1)
        gram = np.full(m, n, np.uint64)
        for k in range(n):
            gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + framed[k: k + m])
        same = owner[:m] == owner[n - 1: n - 1 + m]
        if n == 1:
            same &= framed != 0x20
        word.append(owner[:m][same])
        slot.append((gram[same] % np.uint64(GRAM_SLOTS)).astype(np.int64))
    return np.concatenate(word), np.concatenate(slot)


def distinct_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word codes, distinct words, first word of each row (n + 1 values)."""
    starts, ends, first = word_spans(data, off)
    size = ends - starts
    inside = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    packed = data[inside]
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    coded = coded.dictionary_encode()
    return np.asarray(coded.indices), [w.decode() for w in coded.dictionary.to_pylist()], first


@dataclass
class LanguageModel:
    """Languages in order, log probability of each gram slot, and the scripts each language writes."""

    languages: list[str]
    gram: np.ndarray
    scripts: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word x language) and letters of each word; words without letters score 0."""
        n, k = len(words), len(self.languages)
        points, owner, found = word_letters(words)
        letters = np.bincount(owner, minlength=n)
        word, slot = letter_grams(points, owner, n)
        count = np.maximum(np.bincount(word, minlength=n), 1)
        scores = np.empty((n, k))
        for j in range(k):
            # only words in scripts that the language writes are scored for it
            writes = (found & ~self.scripts[j]) == 0
            if writes.all():
                use_word, use_slot = word, slot
            else:
                use = writes[word]
                use_word, use_slot = word[use], slot[use]
            # the mean gram score times a slowly growing length keeps very long words from deciding alone
            total = np.bincount(use_word, self.gram[j][use_slot], n)
            scores[:, j] = np.where(writes, total / count, _FAR) * np.sqrt(count)
        scores[letters == 0] = 0.0
        return scores, letters

    def label(self, scores: np.ndarray, letters: np.ndarray, codes: np.ndarray,
              first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
        """For each row: language index (-1: none), score, and the path of words where it is not constant."""
        n, k = len(first) - 1, len(self.languages)
        steps = scores[codes]
        weight = letters[codes]
        has = np.add.reduceat(np.append(weight, 0), first[:-1]) * (np.diff(first) > 0) > 0
        sums = np.stack([np.concatenate([[0.0], np.cumsum(steps[:, j])]) for j in range(k)], axis=1)
        total = sums[first[1:]] - sums[first[:-1]]
        best = total.argmax(axis=1)
        row = np.repeat(np.arange(n), np.diff(first))
        gain = steps - steps[np.arange(len(steps)), best[row]][:, None]
        worst = np.zeros(n)
        for j in range(k):
            worst = np.maximum(worst, _largest_run(gain[:, j], row, first))
        lang = np.where(has, best, -1)
        second = np.where(np.arange(k) == best[:, None], -np.inf, total).max(axis=1) if k > 1 else np.full(n, -np.inf)
        margin = total[np.arange(n), best] - second
        score = np.where(has, 1.0 / (1.0 + np.exp(-np.clip(margin, 0, 50))), 0.0)
        paths: list[np.ndarray | None] = [None] * n
        for r in np.flatnonzero(has & (worst >= penalty)):
            a, b = first[r], first[r + 1]
            path = viterbi(steps[a:b], penalty)
            shares = np.bincount(path, weight[a:b], k)
            lang[r] = shares.argmax()
            score[r] = shares.max() / shares.sum()
            paths[r] = path
        return lang, score, paths


def _largest_run(gain: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest sum of a run of consecutive words, per row (0 at least)."""
    n = len(first) - 1
    if not len(gain):
        return np.zeros(n)
    # rows are set apart by a drop larger than any sum, so the running minimum starts anew in each
    apart = 2.0 * (np.abs(gain).sum() + 1.0)
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    shift = -apart * row
    low = np.minimum.accumulate(sums[:-1] + shift)
    top = sums[1:] + shift - low
    out = np.zeros(n)
    np.maximum.at(out, row, top)
    return out


def viterbi(steps: np.ndarray, penalty: float) -> np.ndarray:
    """Best path through (word x language) scores when each change of language costs ``penalty``."""
    n, k = steps.shape
    back = np.empty((n, k), np.int32)
    value = steps[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        lead = int(value.argmax())
        jump = value[lead] - penalty
        change = jump > value
        back[t] = np.where(change, lead, stay)
        value = np.where(change, jump, value) + steps[t]
    path = np.empty(n, np.int64)
    path[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit_languages(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str,
                  per_language: int) -> LanguageModel:
    """Counts from the ``per_language`` labelled rows of smallest hash of each language (whole texts).

    The hash is over id and text; rows equal in both count once.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"),
                       learn.alias("_learn"), F.xxhash64(id_col, text_col).alias("_hash"))
    marked = rows.filter(F.col("_learn") & F.col("_lang").isNotNull())
    hashes = materialize(marked.select("_lang", "_hash").distinct(), "language-hashes")
    # the hash of the last row taken of each language: a row per language
    last = values_at_ranks(hashes, "_hash", {"_last": lambda n: min(per_language, n) - 1}, ["_lang"])
    languages = sorted(r["_lang"] for r in last.select("_lang").collect())
    limits = F.broadcast(last.select(F.col("_lang").alias("_of"), "_last"))
    sample = marked.join(limits, (F.col("_lang") == F.col("_of")) & (F.col("_hash") <= F.col("_last")))
    sample = sample.groupBy("_lang", "_hash").agg(F.any_value("_text").alias("_text")).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {name: np.zeros(GRAM_SLOTS, np.int64) for name in languages}
        scripts = {name: np.zeros(len(SCRIPT_STARTS), np.int64) for name in languages}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            data, off = text_bytes(batch.column(1))
            for a, b in row_ranges(off, _SLICE_BYTES):
                codes, words, first = distinct_words(data[off[a]: off[b]], off[a: b + 1] - off[a])
                if not words:
                    continue
                names = np.repeat(labels[a:b], np.diff(first))
                points, owner, writes = word_letters(words)
                word, slot = letter_grams(points, owner, len(words))
                for name in set(labels[a:b]):
                    times = np.bincount(codes[names == name], minlength=len(words))
                    grams[name] += np.bincount(slot, times[word], GRAM_SLOTS).astype(np.int64)
                    for k in range(len(SCRIPT_STARTS)):
                        scripts[name][k] += int(times[(writes >> k) & 1 == 1].sum())
        for name in languages:
            slots = np.flatnonzero(grams[name])
            used = np.flatnonzero(scripts[name])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(slots) + len(used)), pa.string()),
                 pa.array(np.concatenate([slots, -1 - used])),
                 pa.array(np.concatenate([grams[name][slots], scripts[name][used]]))], names=["lang", "slot", "n"])

    counts = sample.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most languages x (slots + scripts) rows
    at = {name: j for j, name in enumerate(languages)}
    j = np.array([at[x] for x in table.column(0).to_pylist()], np.int64)
    slot, n = table.column(1).to_numpy(), table.column(2).to_numpy()
    grams = np.full((len(languages), GRAM_SLOTS), 0.5)
    use = slot >= 0
    grams[j[use], slot[use]] += n[use]
    writes = np.zeros((len(languages), len(SCRIPT_STARTS)))
    writes[j[~use], -1 - slot[~use]] = n[~use]
    share = writes / np.maximum(writes.sum(axis=1, keepdims=True), 1)
    scripts = ((share > 0.001) @ (1 << np.arange(len(SCRIPT_STARTS)))).astype(np.int64)
    return LanguageModel(languages, np.log(grams / grams.sum(axis=1, keepdims=True)), scripts)


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_language: int = SAMPLE_PER_LANGUAGE, penalty: float = SWITCH_PENALTY,
             spans: bool = False) -> DataFrame:
    """Id, lang_pred, score; with ``spans`` also the list of (first word, words, language)."""
    model = fit_languages(docs, learn, id_col, text_col, lang_col, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [*model.languages, "und"]
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            langs, scores, runs = [], [], []
            for a, b in row_ranges(off, _SLICE_BYTES):
                codes, words, first = distinct_words(data[off[a]: off[b]], off[a: b + 1] - off[a])
                if not model.languages or not words:
                    lang, score, paths = np.full(b - a, -1), np.zeros(b - a), [None] * (b - a)
                else:
                    lang, score, paths = model.label(*model.word_scores(words), codes, first, penalty)
                langs += [names[j] for j in lang.tolist()]
                scores += score.tolist()
                if spans:
                    size = np.diff(first)
                    runs += [_runs(p, int(n), int(j), names) for p, n, j in zip(paths, size, lang)]
            out = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(runs, span_type)] if spans else []),
                                             names=["_id", "lang_pred", "score"] + ["spans"] * spans)

    kind = source.schema["_id"].dataType.simpleString()
    more = ", spans array<struct<start:long,words:long,lang:string>>" if spans else ""
    return source.mapInArrow(predict, f"_id {kind}, lang_pred string, score double{more}").withColumnRenamed("_id", id_col)


def _runs(path: np.ndarray | None, n: int, lang: int, names: list[str]) -> list[dict]:
    if path is None:
        return [{"start": 0, "words": n, "lang": names[lang]}] if n and lang >= 0 else []
    cuts = np.flatnonzero(np.diff(path)) + 1
    starts = np.concatenate([[0], cuts])
    return [{"start": int(s), "words": int(e - s), "lang": names[path[s]]}
            for s, e in zip(starts, np.append(cuts, n))]


def language_predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         lang_col: str = "lang") -> DataFrame:
    """Id, held_out, lang_pred, score; rows whose crc32(id) mod 4 is 2 are never learnt from."""
    out = identify(docs, ~held_out(id_col, 4, 2), id_col, text_col, lang_col)
    return out.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "lang_pred", "score")
