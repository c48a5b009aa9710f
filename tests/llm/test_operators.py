"""Operators against brute force on small hand-made tables: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderlens.llm import decontaminate, exact_dedup, language_id, line_dedup, minhash, quality, url_filter
from orderlens.llm.common import held_out, text_bytes
from orderlens.llm.packing import OpenBins, best_fit_packing
from orderlens.llm.pieces import BytePair, WordBpe, tiles
from orderlens.llm.substring_dedup import substring_dedup
from orderlens.llm.token_counts import section_of, section_token_counts
from orderlens.llm.words import folded_text

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# extra columns whose names operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, h int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 150)) for _ in range(25)]
    shared = words(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[3]), (101, base[3].replace(" ", " \t\n")), (102, base[4] + " "), (103, None), (104, ""),
             (105, " \n "), (106, "a " * 300), (107, words(rng, 20) + " " + shared + "\n" + words(rng, 5)),
             (108, shared + " " + words(rng, 70)), (109, words(rng, 12000)), (None, base[7]), (None, None),
             (110, "ünï — “qu’ote” ñ 12"), (110, "ünï — “qu’ote” ñ 12"), (111, "x" * 50000)]
    return rows


def empty(spark):
    return docs_of(spark, []).limit(0)


def test_exact_dedup_matches_brute_force(spark, corpus):
    got = exact_dedup.exact_dedup(docs_of(spark, corpus)).collect()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in corpus]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    expect = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        expect.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(expect, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_widens_identifiers_when_chunks_collide(spark, corpus):
    plain = exact_dedup.exact_dedup(docs_of(spark, corpus)).drop("kept").collect()
    narrow = exact_dedup.exact_dedup(docs_of(spark, corpus), width=1, bits=4).drop("kept").collect()
    assert sorted(map(str, plain)) == sorted(map(str, narrow))


def test_exact_dedup_stage_keeps_one_row_of_each_text(spark, corpus):
    kept = exact_dedup.keep_first_texts(docs_of(spark, corpus))
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in corpus})
    assert kept.columns == docs_of(spark, corpus).columns


def test_substring_dedup_matches_brute_force(spark, corpus):
    split = [(i, (t or "").encode().split()) for i, t in corpus]
    for window in (35, 6):
        seen = Counter(tuple(w[k: k + window]) for _, w in split for k in range(len(w) - window + 1))
        expect = []
        for i, w in split:
            gone = [False] * len(w)
            for k in range(len(w) - window + 1):
                if seen[tuple(w[k: k + window])] > 1:
                    gone[k: k + window] = [True] * window
            kept = b" ".join(x for x, g in zip(w, gone) if not g)
            expect.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
        got = substring_dedup(docs_of(spark, corpus), window=window, batch_bytes=4096).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(expect)
    assert substring_dedup(empty(spark)).count() == 0


TRICKY = ["", "  ", "a<|endoftext|>b c <|ENDOFTEXT|>", "Don't 'S it''s \x1cq\x1f z\u00a0y İstanbul ΑΣ ß ﬁ e\u0301 \u0301x",
          "日本語テキスト 123 4a5", "'ll!!'s", " lead", "trail \n", "×÷ÉÀß12é3 a×b Ü.Ö É's — a—b“c”. 1½ ²x ªº", "ÀÉ ÿ ŸŒ"]


def test_word_pieces_equal_whole_text_encoding(corpus):
    tok, bpe = Tokenizer.from_file(WORD_BPE), WordBpe(WORD_BPE)
    texts = TRICKY + [t for _, t in corpus if t]
    data, off = text_bytes(pa.array(texts))
    codes, distinct, first = bpe.pieces(data, off)
    table = bpe.encode_pieces(distinct)
    for r, t in enumerate(texts):
        assert table.expand(codes[first[r]: first[r + 1]]).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_byte_tiles_equal_whole_text_encoding(corpus):
    bpe = BytePair(RANKS, public_tokenizers.PATTERN)
    texts = TRICKY + ["a\n\nb  c \n d\t\te", "\n\n\n"] + [t for _, t in corpus if t]
    data, off = text_bytes(pa.array(texts))
    codes, distinct, first, _ = tiles(data, off)
    table = bpe.encode_tiles(distinct)
    for r, t in enumerate(texts):
        ids = table.expand(codes[first[r]: first[r + 1]])
        assert ids.tolist() == bpe.encoding.encode_ordinary(t)
        assert int(bpe.width[ids].sum()) == len(t.encode())


def test_byte_tiles_keep_runs_of_unicode_space_whole():
    bpe = BytePair(RANKS, public_tokenizers.PATTERN)
    spaces = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    near = ["\u200b", "\u180e", "\ufeff", "\x1c", "\u2060", "\u2010", "\u3001", "\u00a9"]  # not white space
    texts = ["a \xa0 \xa0 b", " \xa0 \xa0 \xa0 \xa0 x", "Menu" + " \xa0" * 8 + " Home", "a \xa0\n\xa0\n b\xa0\n", "\xa0", "\u3000 "]
    texts += [f"a{c}{c} {c}b {c} \n{c}9{c}" for c in spaces + near]
    rng = random.Random(12)
    texts += ["".join(rng.choice(spaces + near + ["a", "é", "1", "."]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    data, off = text_bytes(pa.array(texts))
    codes, distinct, first, _ = tiles(data, off)
    table = bpe.encode_tiles(distinct)
    for r, t in enumerate(texts):
        assert table.expand(codes[first[r]: first[r + 1]]).tolist() == bpe.encoding.encode_ordinary(t), t


def test_packing_keeps_every_id_and_fills_sequences(spark, corpus):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = best_fit_packing(docs_of(spark, corpus), WORD_BPE, max_length=256, group_rows=10).collect()
    expect = []
    for i, t in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at: at + 256], "<u4")
            expect.append((str(i), k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expect)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert best_fit_packing(empty(spark), WORD_BPE).count() == 0


def test_fullest_bin_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 (fullest) closed
    assert bins.place(3) == (0, 6)
    assert bins.place(2) == (2, 8)


def test_quality_learns_junk_and_scores_every_row(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 40) if i % 4 else "spam!! " * rng.randint(5, 30)) for i in range(400)]
    extra = [(1000, None), (1001, ""), (1002, "x" * 30000), (None, "spam!! spam!!")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(3, 0, 0), (None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_predictions(docs_of(spark, rows + extra), labels).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 4 > 0)
    none = quality.quality_predictions(docs_of(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality.quality_predictions(empty(spark), labels).count() == 0
    kept = quality.accepted(docs_of(spark, rows), labels)
    assert kept.columns == docs_of(spark, rows).columns and 290 <= kept.count() <= 302


def brute_tiles(item, text, least):
    """Longest common unmarked run again and again, by direct comparison."""
    a, b, out = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(text)):
                n = 0
                while (p + n < len(item) and q + n < len(text) and item[p + n] == text[q + n]
                       and not a[p + n] and not b[q + n]):
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return out
        a[p: p + n] = [True] * n
        b[q: q + n] = [True] * n
        out += n


def test_greedy_tiles_cover_as_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        text = [rng.randint(0, 30) for _ in range(20)] + item[10:] + [99] + item[:10] + [rng.randint(0, 30)]
        found = decontaminate.greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), 5)
        marked = set()
        for p, q, n in found:
            assert item[p: p + n] == text[q: q + n]
            assert not marked & set(range(p, p + n))
            marked |= set(range(p, p + n))
        assert len(marked) == brute_tiles(item, text, min(5, len(item)))


def test_decontamination_finds_whole_and_reordered_items(spark):
    rng = random.Random(4)
    item = words(rng, 40).split()
    rows = [(1, words(rng, 30) + " " + " ".join(item).upper() + ". " + words(rng, 9)),
            (2, " ".join(item[20:]) + " " + words(rng, 5) + " " + " ".join(item[:20])),
            (3, " ".join(item[:12]) + " " + words(rng, 60)), (4, words(rng, 50)), (5, None), (6, ""), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "one two"), (9, None), (10, "")], "item_id long, text string")
    for block in (1 << 20, 1):  # one block of items, and a block each
        got = decontaminate.benchmark_overlaps(docs_of(spark, rows), bench, block_bytes=block).collect()
        by = {r.doc_id: r for r in got if r.item_id == 7}
        assert set(by) == {1, 2, 3, None}
        assert {d: r.contaminated for d, r in by.items()} == {1: True, 2: True, 3: False, None: True}
        assert by[1].coverage == by[2].coverage == 1.0 and by[3].covered_words == 12
    kept = decontaminate.without_contaminated(docs_of(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6"]
    assert kept.columns == docs_of(spark, rows).columns
    assert decontaminate.benchmark_overlaps(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.benchmark_overlaps(empty(spark), bench).count() == 0


ACCENTED = ("l’été où naïve Élodie mangeait des œufs à Genève près du château la señora Muñoz bebía café mañana "
            "größere Straßen führen über schöne Brücken ins Tal").split()


def test_folded_words_are_runs_of_unicode_letters_and_digits():
    texts = ["Ünï — “Qu’ote” Ñ12\xa0Y…z", "ΑΣ ας 日本、語 𝔘x😀y ½", None, "", "Don't A_b", "e\u0301 É", "İ ß ẞ"]
    data, off = folded_text(pa.array(texts))
    got = [bytes(data[a:b]).decode().split() for a, b in zip(off, off[1:])]
    assert got == [["ünï", "qu", "ote", "ñ12", "y", "z"], ["ας".replace("ς", "σ")] * 2 + ["日本", "語", "𝔘x", "y", "½"], [], [],
                   ["don", "t", "a", "b"], ["é", "é"], ["i", "ss", "ss"]]


def test_decontamination_finds_items_with_other_case_and_signs(spark):
    item = " ".join(ACCENTED)
    rows = [(1, "x y " + item.upper() + " z"), (2, item.replace(" ", "\xa0").replace("’", "'")), (3, item.replace(" ", " – “")),
            (4, " ".join(ACCENTED[:9])), (5, unicodedata.normalize("NFD", item))]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.benchmark_overlaps(docs_of(spark, rows), bench).collect()
    assert {r.doc_id: r.contaminated for r in got} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert {r.coverage for r in got if r.contaminated} == {1.0}
    assert [r.doc_id for r in decontaminate.without_contaminated(docs_of(spark, rows), bench).collect()] == [4]


def test_near_duplicates_with_other_case_and_signs_meet(spark):
    text = " ".join(ACCENTED)
    rows = [(1, text), (2, text.upper()), (3, text.replace("’", "'").replace(" ", "\xa0")),
            (4, "“" + text.replace(" ", "” — “") + "…"), (5, " ".join(reversed(ACCENTED)))]
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    n, joint = 300, 200
    a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
    b = np.concatenate([a[:joint], rng.integers(0, 2 ** 63, n - joint).astype(np.uint64)])
    wa = rng.random(n) * 5
    wb = np.concatenate([wa[:joint] * rng.random(joint) * 1.3, rng.random(n - joint)])
    left, right = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    keys = set(left) | set(right)
    true = (sum(min(left.get(k, 0), right.get(k, 0)) for k in keys)
            / sum(max(left.get(k, 0), right.get(k, 0)) for k in keys))
    sig = minhash.dart_signatures(np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_near_duplicates_match_brute_force_classes(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, 120).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, rows[0][1].upper()), (n + 1, None), (n + 2, ""), (n + 3, "!!"), (n + 4, "two words"),
             (n + 5, "Two, words!"), (None, rows[0][1])]

    def grams(t):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        return {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {i: root(i) for i in sets}
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(0, False)]
    kept = minhash.keep_one_of_each(docs_of(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {root(i) for i in sets}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_a_shared_passage_match_brute_force(spark):
    """Documents of 100 shingles, 85 of them of one passage (Jaccard 0.74); half share 5 more with a partner (0.82)."""
    rng = np.random.default_rng(21)
    passage = " ".join(f"p{k}" for k in range(89))
    n = 2400
    own = [[f"w{v}" for v in rng.integers(0, 10 ** 9, 15)] for _ in range(n)]
    for i in range(0, n // 2, 2):
        own[i + 1][:5] = own[i][:5]
    order = rng.permutation(n).tolist()
    rows = [(order[i], passage + " " + " ".join(own[i])) for i in range(n)]
    code, cells = {}, []
    for i, t in rows:
        w = t.split()
        cells += [(i, code.setdefault(tuple(w[k: k + 5]), len(code))) for k in range(len(w) - 4)]
    at = np.array(cells)
    held = np.zeros((n, len(code)), np.float32)
    held[at[:, 0], at[:, 1]] = 1
    joint = held @ held.T
    size = held.sum(axis=1)
    similar = joint >= 0.8 * (size[:, None] + size[None, :] - joint)
    expect = {i: int(np.flatnonzero(similar[i])[0]) for i in range(n)}  # classes are pairs at most
    assert sum(i != c for i, c in expect.items()) == n // 4
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == expect


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance_equals_edit_distance(spark):
    rng = random.Random(8)
    pairs = [("abc", "abc"), ("abc", ""), ("a😀b", "ab"), ("ab", "abcd"), ("kitten", "sitting")]
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            b[k: k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        pairs.append((a, "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", line_dedup.characters(F.col("a")).alias("x"), line_dedup.characters(F.col("b")).alias("y"))
    for threshold in (1, 2, 3):
        d = line_dedup.banded_distance(F.col("x"), F.col("y"), threshold).alias("d")
        for r in table.select("a", "b", d).collect():
            assert r.d == min(edit_distance(r.a, r.b), threshold + 1), (r.a, r.b, threshold)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    pool = [words(rng, rng.randint(1, 6)) for _ in range(25)] + ["ab", "abc", "abd", "x", "日本語の行です", "日本語の行です。"]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(line) + 1)
                line[k: k + rng.randint(0, 1)] = rng.choice(["", "q", "e"])
            lines.append("  " * rng.randint(0, 1) + "".join(line))
        rows.append((i, "\n".join(lines) + "\n" * rng.randint(0, 2)))
    rows += [(50, None), (51, ""), (52, rows[1][1]), (None, "only here " * 4)]
    occur = [((i is None, i or 0, k), t.strip(" \t\n\x0b\f\r")) for i, text in rows
             for k, t in enumerate((text or "").split("\n")) if t.strip(" \t\n\x0b\f\r")]
    first, stays = {}, []
    for place, t in sorted(occur):
        if t not in first:
            first[t] = place
            near = any(min(len(t), len(u)) > 2 and edit_distance(t, u) <= min(2, max(len(t), len(u)) // 5) for u in stays)
            if not near:
                stays.append(t)
    assert 0 < len(first) - len(stays)
    expect = {i: sorted(p[2] for p, t in occur if p[:2] == (i is None, i or 0) and (t not in stays or first[t] != p)) for i, _ in rows}
    got = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.removed_lines for r in got} == expect
    assert len(got) == len(rows)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_tells_rows_of_one_id_and_of_no_id_apart(spark):
    text = "first common line\nsecond common line\n\nown words of this text"
    rows = [(1, text), (1, text), (2, "other things\nfirst common line"), (None, "null one here\nsecond common line"),
            (None, "null one here\nlast of its kind"), (None, None), (None, ""), (None, "\n\nlast of its kind"), (3, None), (3, "")]
    got = line_dedup.line_dedup(docs_of(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and all(r.n_removed == len(r.removed_lines) for r in got)
    of = {i: sorted((r.n_lines, tuple(r.removed_lines)) for r in got if r.doc_id == i) for i in (1, 2, 3, None)}
    assert of[1] == [(3, ()), (3, (0, 1, 3))] and of[2] == [(2, (1,))] and of[3] == [(0, ()), (0, ())]
    assert sorted(r[0] for r in of[None]) == [0, 0, 1, 2, 2]
    # a line that only null-id rows have stays in one of them; one that others have stays in none
    assert sum(len(r[1]) for r in of[None]) == 3


def test_url_filter_equals_direct_matching(spark):
    rng = random.Random(1)
    hosts = ["www.Example.com", "example.com", "a.b.example.com", "notexample.com", "x.net", "net", "m.org", "com", ""]
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com", "http://x.net/es/?q#f", "a://b://c.com/", "http://x.com?y/z"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/1?x=1', '/es/', '/fr/#t', '/en', '?q'])}" for _ in range(200)]
    allow, block = [("com", "/"), ("www.example.com", "/en/")], [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    for r in url_filter.judge_urls(pages, allow, block).collect():
        url = urls[r.page_id]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p) for h, p in allow + block if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == ("block" if rule in {h + p for h, p in block} else "allow")
    assert url_filter.judge_urls(pages.limit(0), allow, block).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [], []).collect()} == {"allow"}


def test_cascade_is_exact_over_the_universe(spark):
    keys = [f"k{i}" for i in range(5000)]
    listed = keys[::7]
    cascade = url_filter.build_cascade(listed, spark.createDataFrame([(k,) for k in keys], "key string"))
    assert [k for k in keys if k in cascade] == listed
    assert len(cascade.levels) > 2


def test_language_spans_and_undetermined_texts(spark):
    rng = random.Random(7)
    sound = {"aa": "abcde", "bb": "vwxyz"}

    def text(lang, n):
        return " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(3, 8))) for _ in range(n))

    rows = [(i, text(lang, 30), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(300, text("aa", 20) + " 12 " + text("bb", 30), None), (301, None, "aa"), (302, "12 !!", "bb"),
             (303, "", None), (None, text("bb", 9), None)]
    docs = spark.createDataFrame([(i, t, la, "s") for i, t, la in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.language_predictions(docs).collect()}
    for i, _, la in rows[:200]:
        assert got[i].lang_pred == la and 0 <= got[i].score <= 1
    assert got[300].lang_pred == "bb" and got[None].lang_pred == "bb"
    assert {got[i].lang_pred for i in (301, 302, 303)} == {"und"}
    mixed = language_id.identify(docs, ~held_out("doc_id", 4, 2), spans=True).filter("doc_id = 300").first()
    assert [(s.lang) for s in mixed.spans] == ["aa", "bb"] and sum(s.words for s in mixed.spans) == 51
    blank = language_id.language_predictions(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in blank.collect()} == {"und"}
    assert language_id.language_predictions(docs.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    from itertools import product
    for _ in range(40):
        steps = rng.normal(size=(6, 3)) * 2

        def value(path):
            return sum(steps[t, j] for t, j in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

        best = max(product(range(3), repeat=6), key=value)
        assert abs(value(tuple(language_id.viterbi(steps, 1.5))) - value(best)) < 1e-9


def test_token_counts_add_up_and_follow_the_rule(spark, corpus):
    rows = corpus + [(200, "a\n\n\nb c\n"), (201, "\n\n")]
    bpe = BytePair(RANKS, public_tokenizers.PATTERN)
    for rule in ("first", "last", "most"):
        got = section_token_counts(docs_of(spark, rows), RANKS, public_tokenizers.PATTERN, rule=rule).collect()
        for i, t in rows:
            if i is None or i == 110:
                continue
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            lines = re.findall(r"[^\n]*\n|[^\n]+", t or "") or [""]
            assert [r.n_bytes for r in mine] == [len(x.encode()) for x in lines]
            ids = bpe.encoding.encode_ordinary(t or "")
            ends = np.cumsum([len(bpe.encoding.decode_single_token_bytes(x)) for x in ids])
            starts = np.concatenate([[0], ends[:-1]]) if ids else np.zeros(0)
            expect = [0] * len(lines)
            bounds = np.cumsum([0] + [len(x.encode()) for x in lines])
            for s, e in zip(starts, ends):
                inside = [min(e, bounds[k + 1]) - max(s, bounds[k]) for k in range(len(lines))]
                parts = [k for k, n in enumerate(inside) if n > 0]
                expect[{"first": parts[0], "last": parts[-1], "most": max(parts, key=lambda k: inside[k])}[rule]] += 1
            assert [r.n_tokens for r in mine] == expect
    assert section_of(np.array([0, 3]), np.array([3, 9]), np.array([0, 4]), "most").tolist() == [0, 1]
    with pytest.raises(ValueError):
        section_token_counts(docs_of(spark, rows), RANKS, public_tokenizers.PATTERN, rule="half")
    assert section_token_counts(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
