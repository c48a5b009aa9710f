"""Merkle manifest, byte-string dedup and token alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from orderlens.llm import (
    decontaminate, exact_dedup, language_id, line_dedup, merkle, minhash, quality, repeat_spans, run_index, substring_dedup,
    token_align, url_filter,
)
from orderlens.llm.words import word_hashes, word_spans

# extra columns whose names operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, batch long, _g int, leaf string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def docs_of(spark, rows):
    full = [(i, t, lang, "s" if (i or 0) % 3 else None, len(t) if t else None, "x", 7, 1, "l") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root and, per leaf, the list of (left, right) siblings."""
    proofs, place, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 8 * 8: p // 8 * 8 + 8]
            proofs[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1:])))
            place[k] = p // 8
        nodes = [h(*nodes[i: i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def manifest(rows):
    """Brute force: (doc_id, leaf, subroot, root, proof) of rows in the order of FIELDS."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs[g] = tree([leaf_of(r) for r in groups[g]])
    root, top = tree([subs[g][0] for g in order])
    return [(r[0], leaf_of(r), subs[g][0], root, tuple(p + q)) for g, q in zip(order, top)
            for r, p in zip(groups[g], subs[g][1])]


def check_manifest(spark, rows):
    docs = docs_of(spark, rows)
    plain = [tuple(r) for r in docs.select(*FIELDS).collect()]
    text = F.translate("text", "ABC", "abc")
    got = merkle.merkle_proofs(docs, "doc_id", "lang", FIELDS, {
        "shown": merkle.leaf_digest([text if c == "text" else F.col(c) for c in FIELDS])})
    got = got.withColumns({"back": merkle.fold(F.col("leaf"), F.col("proof")), "bad": merkle.fold(F.col("shown"), F.col("proof")),
                           "sha": merkle.proof_digest(F.col("proof"))}).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((l.left, l.right) for l in r.proof)) for r in got) == Counter(manifest(plain))
    assert all(r.back == r.root for r in got)
    assert all((r.bad == r.root) == (r.shown == r.leaf) for r in got)
    assert all(r.sha == h(*[l.left + l.right for l in r.proof]) for r in got)


def test_merkle_manifest_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(0, 9)).title(), rng.choice(["en", "de", None, "fr"])) for i in range(150)]
    rows += [(None, None, "en"), (None, "", None), (None, "B", "en"), (7, "Twice", "en"), (7, "Twice", "en"), (7, "twice", "en"),
             (900, "alone", "zz"), (901, "É" * 20000, "é"), (-4, "minus", "en")]
    rng.shuffle(rows)
    check_manifest(spark, rows)


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [513], [64, 65, 4097], [1] * 70])
def test_merkle_levels_are_right_at_the_edges(spark, sizes, monkeypatch):
    # blocks of 8 leaves, so that several rounds of exchange are needed
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    check_manifest(spark, [(i, "x", f"g{g:03}") for g, n in enumerate(sizes) for i in range(n)])


def test_merkle_of_an_empty_table(spark):
    assert merkle.merkle_proofs(docs_of(spark, []), "doc_id", "lang", FIELDS).count() == 0


def lower_spans(rows, window=50):
    """Brute force for byte strings that also start in a document of a smaller id (null: the largest)."""
    key = lambda i: (i is None, i or 0)
    low = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - window + 1):
            s = data[p: p + window]
            low[s] = min(low.get(s, key(i)), key(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - window + 1):
            if low[data[p: p + window]] < key(i):
                gone[p: p + window] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def repetitive():
    rng = random.Random(8)
    shared = [words(rng, 30) for _ in range(4)]
    rows = [(i, words(rng, rng.randint(0, 30)) + rng.choice(["", " "]) + rng.choice(shared + [""])[rng.randint(0, 40):] + words(rng, 9))
            for i in range(60)]
    rows += [(61, rows[5][1]), (62, rows[5][1] + "x"), (5, rows[6][1]), (61, shared[0]), (None, shared[1]), (None, shared[1]), (None, None),
             (63, ""), (64, "ab" * 3000), (65, "b" + "ab" * 100), (66, "z" * 400), (67, "z" * 60), (-1, shared[2][20:90]),
             (68, words(rng, 4000) + shared[3]), (69, shared[3][:49]), (70, "漢字" * 40), (71, "字漢字" * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot, batch, bucket", [(1 << 16, 4 << 20, 8 << 20), (1 << 16, 2000, 3000), (3, 2000, 3000), (0, 10**9, 10**9)])
def test_repeat_spans_match_brute_force(spark, repetitive, hot, batch, bucket):
    docs = docs_of(spark, [(i, t, "en") for i, t in repetitive]).repartition(3)
    got = repeat_spans.repeat_spans(docs, hot=hot, batch_bytes=batch, bucket_bytes=bucket, keep_bytes=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == lower_spans(repetitive)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_repeat_spans_take_text_ids_and_other_windows(spark, repetitive):
    rows = [(None if i is None else i + 2, t) for i, t in repetitive]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows]).withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    got = repeat_spans.repeat_spans(docs, window=33).collect()
    want = lower_spans(rows, 33)
    assert Counter((r.doc_id and int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_repeat_spans_of_an_empty_table(spark):
    assert repeat_spans.repeat_spans(docs_of(spark, [])).count() == 0


def test_run_index_gives_matching_statistics():
    rng = random.Random(1)
    for trial in range(120):
        letters = "ab" if trial % 2 else "abcdef"
        base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        strings = []
        for _ in range(rng.randint(1, 12)):
            s = rng.choice(base)
            i = rng.randint(0, len(s))
            strings.append(s[:i] + rng.choice(["", "x", "y"]) + s[i:])
        depth = rng.choice([8, 9, 12, 16, 20])
        text = np.frombuffer(b"".join(s.encode() + b"\xff" for s in strings), np.uint8)
        rows, new = run_index.suffix_order(text, depth)
        end_of = {int(e): 256 + k for k, e in enumerate(np.flatnonzero(text == 255))}
        listed = [end_of.get(k, int(c)) for k, c in enumerate(text)]
        order = sorted(range(len(text)), key=lambda k: listed[k:])
        assert rows.tolist() == order
        assert new[1:].tolist() == [listed[a: a + depth] != listed[b: b + depth] for a, b in zip(order, order[1:])]
        patterns = [*rng.choices(strings, k=4), "".join(rng.choice(letters + "z") for _ in range(30)), "", rng.choice(base)]
        data = np.frombuffer(b"".join(s.encode() + b"\xff" for s in patterns), np.uint8)
        end = np.flatnonzero(data == 255)
        begin = np.append(0, end[:-1] + 1)
        length, row = run_index.RunIndex(text, depth).matches(data, begin, end)
        for s, b in zip(patterns, begin.tolist()):
            for p in range(len(s)):
                best = max(n for n in range(min(depth, len(s) - p) + 1) if any(s[p: p + n] in t for t in strings))
                assert length[b + p] == best
                if best:
                    at = order[row[b + p]]
                    assert bytes(text[at: at + best]).decode() == s[p: p + best]


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def aligned(text, tok, sp, token_a, token_b):
    """Brute force: ids of A and B, groups, links; None where there are no tokens."""
    if not text:
        return None
    whole = " " + text
    ids_a, ids_b = tok.encode(whole, add_special_tokens=False).ids, sp.encode(text)
    if b"".join(token_a[i] for i in ids_a) != whole.encode() or b"".join(token_b[i] for i in ids_b) != whole.encode():
        return None
    spans = []
    for ids, token in ((ids_a, token_a), (ids_b, token_b)):
        ends = np.cumsum([len(token[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends, ids)))
    links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = [[",".join(str(i) for s, e, i in side if a < e <= b) for side in spans] for a, b in zip([0, *cuts], cuts)]
    return len(ids_a), len(ids_b), groups, links


def test_token_alignment_matches_brute_force(spark):
    rng = random.Random(2)
    alphabet = ["the", "don't", " ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "　", "漢字", "é", "😀", "<|endoftext|>", "<s>", "<0x0A>",
                "1234", "xyz" * 5, "--", "'ll", "\x00", "\x85", "Überraschung", "naïve"]
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " ", "   ", "\n", "a", "a ", "a  ", "▁x", "a▁b", "a" * 1500, texts[3], words(rng, 700)]
    rows = [(None if k == 5 else k // 2, t, "en") for k, t in enumerate(texts)]
    tok = Tokenizer.from_file(BYTE_BPE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    token_a, token_b = token_align.ByteLevel(BYTE_BPE).token, token_align.Pieces(PIECES).token
    each = [aligned(t, tok, sp, token_a, token_b) for t in texts]
    assert all((e is None) == (not t or "▁" in t) for e, t in zip(each, texts))
    count = Counter(p for e in each if e for p in set(e[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for (i, _, _), e in zip(rows, each):
        if e is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = e
            want.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                         h(";".join("|".join(g) for g in groups))))
    docs = docs_of(spark, rows).repartition(4)
    for batch in (3000, 2 << 20):
        got = token_align.token_alignment(docs, BYTE_BPE, PIECES, batch_bytes=batch)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert token_align.token_alignment(docs_of(spark, []), BYTE_BPE, PIECES).count() == 0


def test_crc_rule_of_the_manifest_query(spark):
    got = spark.range(200).select("id", (F.crc32(F.col("id").cast("string")) % 3 == 0).alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.id).encode()) % 3 == 0) for r in got)


def test_language_sample_takes_the_smallest_hashes(spark):
    """One row of thousands is still learnt from, also where all ids are null."""
    rows = [(None, "der die das und nicht", "de") for _ in range(3000)] + [(k, "the and of with this", "en") for k in range(2000)]
    rows += [(None, "это не тот самый день", "ru")]
    docs = docs_of(spark, rows).repartition(3)
    model = language_id.fit_languages(docs, F.lit(True), "doc_id", "text", "lang", 1)
    assert model.languages == ["de", "en", "ru"]
    got = language_id.identify(docs, F.lit(True), per_language=2).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"de": 3000, "en": 2000, "ru": 1}


def test_scripts_narrow_the_candidates():
    slots = language_id.GRAM_SLOTS
    model = language_id.LanguageModel(["latin", "cyrillic"], np.full((2, slots), -9.0), np.array([1, 1 << 2]))
    scores, letters = model.word_scores(["abc", "это", "abcэ", "12"])
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0] and scores[2, 0] == scores[2, 1] and not scores[3].any()
    far = language_id._FAR
    assert scores[0, 1] / scores[0, 0] == pytest.approx(far / -9.0)


def test_the_shortcut_equals_the_whole_recursion():
    rng = np.random.default_rng(4)
    slots = language_id.GRAM_SLOTS
    model = language_id.LanguageModel(["a", "b", "c"], np.zeros((3, slots)), np.array([1, 1, 1]))
    for _ in range(60):
        n_rows, n_words = 12, int(rng.integers(1, 40))
        words = rng.normal(size=(n_words, 3)) * rng.choice([0.2, 1.0, 4.0])
        letters = rng.integers(0, 3, n_words)
        words[letters == 0] = 0.0
        sizes = rng.integers(0, 30, n_rows)
        first = np.concatenate([[0], np.cumsum(sizes)])
        codes = rng.integers(0, n_words, int(first[-1]))
        penalty = float(rng.choice([0.5, 2.0, 6.0]))
        lang, _, paths = model.label(words, letters, codes, first, penalty)
        for r in range(n_rows):
            mine = codes[first[r]: first[r + 1]]
            if not letters[mine].sum():
                assert lang[r] == -1
                continue
            path = language_id.viterbi(words[mine], penalty)
            value = lambda p: words[mine, p].sum() - penalty * (np.diff(p) != 0).sum()
            mine_path = np.full(len(mine), lang[r]) if paths[r] is None else paths[r]
            assert value(mine_path) == pytest.approx(value(path))
            if paths[r] is not None:
                assert lang[r] == np.bincount(path, letters[mine], 3).argmax()


def test_rows_of_repeated_and_null_ids_are_judged_by_themselves(spark, tmp_path):
    """Ids 3 = A, 5 = A', 5 = B, 9 = B': A and B stay; so does one row of two equal ones, and of null ids."""
    rng = random.Random(11)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(3, a, "en"), (5, a + " end", "en"), (5, b, "en"), (9, b + " end", "en"), (7, c, "en"), (7, c, "en"),
            (None, d, "en"), (None, d + " end", "en"), (None, None, "en"), (None, "", "en")]
    path = str(tmp_path / "documents")
    docs_of(spark, rows).write.parquet(path)
    docs = spark.read.parquet(path)
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in got) == Counter({
        (3, 3, 2, True): 1, (5, 3, 2, False): 1, (5, 5, 2, True): 1, (9, 5, 2, False): 1, (7, 7, 2, True): 1, (7, 7, 2, False): 1,
        (None, None, 2, True): 1, (None, None, 2, False): 1, (None, None, 1, True): 2})
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    texts = Counter(r.text for r in kept.collect())
    assert texts[a] == texts[b] == texts[c] == 1 and texts[d] + texts[d + " end"] == 1 and texts[None] == texts[""] == 1
    bench = spark.createDataFrame([("i1", b), ("i2", d)], "item_id string, text string")
    overlaps = decontaminate.benchmark_overlaps(docs, bench).filter("contaminated").collect()
    assert Counter((r.doc_id, r.item_id) for r in overlaps) == Counter({(5, "i1"): 1, (9, "i1"): 1, (None, "i2"): 2})
    clean = Counter(r.text for r in decontaminate.without_contaminated(docs, bench).collect())
    assert clean == Counter([a, a + " end", c, c, None, ""])


def test_near_duplicates_take_text_ids(spark):
    rng = random.Random(12)
    a = words(rng, 50)
    docs = docs_of(spark, [(1, a, "en"), (2, a + " x", "en"), (3, words(rng, 50), "en")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {"d1": ("d1", True), "d2": ("d1", False), "d3": ("d3", True)}


def test_tiling_of_equal_words_is_bounded():
    one = np.full(20_000, 5, np.uint64)
    start = time.perf_counter()
    tiles = decontaminate.greedy_tiles(one[:2000], one)
    mixed = decontaminate.greedy_tiles(np.tile(np.arange(1, 8, dtype=np.uint64), 200), np.tile(np.arange(1, 7, dtype=np.uint64), 2500))
    assert time.perf_counter() - start < 2
    assert tiles == [(0, 0, 2000)]
    assert sum(n for _, _, n in mixed) == 200 * 6


def test_running_hashes_tell_windows_apart():
    rng = np.random.default_rng(6)
    sequence = rng.integers(1, 4, 400).astype(np.uint64)
    hashes = decontaminate.RunningHashes(sequence, decontaminate.RunningHashes.powers(400))
    for length in (1, 2, 5, 50, 400, 401):
        got = hashes.windows(length)
        want = [tuple(sequence[p: p + length]) for p in range(400 - length + 1)]
        assert len(got) == len(want)
        assert len({(int(h), w) for h, w in zip(got, want)}) == len(set(want)) == len(set(got.tolist()))


def test_word_hashes_have_no_pattern_collisions(spark):
    """The Thue-Morse words of 1024 letters and its complement share any polynomial hash modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    x, y = "".join("ab"[v] for v in bits), "".join("ba"[v] for v in bits)
    samples = [x, y, x[:255], y[:255], x[:256], y[:256], "a", "a\x00", "\x00", "b", "ab", "abcdefgh", "abcdefghi", "abcdefgh\x00", "é" * 200]
    data = " ".join(samples).encode()
    starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(starts) == len(samples)
    first, second = (word_hashes(np.frombuffer(data, np.uint8), starts, ends, salt) for salt in (0, 77))
    assert len(set(first.tolist()) | set(second.tolist())) == 2 * len(samples)
    shared = " ".join(f"w{k}" for k in range(34))
    got = substring_dedup.substring_dedup(docs_of(spark, [(1, f"{shared} {x}", "en"), (2, f"{shared} {y}", "en"), (3, f"{shared} {x}", "en")]))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 35, 2: 0, 3: 35}


def test_lines_are_not_chained_away(spark):
    """Each line is two edits from the next; every second one stays, as it is like none that stays."""
    lines = ["abcdefghijklmno" + "x" * k + "pqrstuvw" for k in range(0, 14, 2)]
    rows = [(k, line, "en") for k, line in enumerate(lines)] + [(20, "short", "en"), (21, "shore", "en"), (22, "tiny", "en"), (23, "tine", "en")]
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert [k for k in range(7) if got[k]] == [1, 3, 5]
    assert got[21] == [0] and not got[20] and not got[22] and not got[23]


def test_hosts_of_many_labels_are_cheap(spark):
    urls = ["http://" + "a." * 30000 + "com/x", "http://" + "b." * 500 + "example.com/en/1", "http://b.net/es/1"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    start = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(
        pages, [("com", "/")], [("example.com", "/en/"), ("net", "/es/")]).select("page_id", "rule", "verdict").collect()}
    assert got == {0: ("com/", "allow"), 1: ("example.com/en/", "block"), 2: ("net/es/", "block")}
    assert time.perf_counter() - start < 60


def test_of_rules_of_one_length_the_longer_host_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/xx/yyyy/")], "page_id long, url string")
    got = url_filter.judge_urls(pages, [("b.com", "/xx/")], [("com", "/xx/yy")]).first()
    assert (got.rule, got.verdict) == ("b.com/xx/", "allow")


def test_the_pipeline_keeps_the_expected_documents(spark, tmp_path):
    """Junk, copies, near copies and contaminated rows go; one row of each clean text stays, whatever its id."""
    rng = random.Random(17)
    good = [" ".join(rng.choice(["river", "stone", "garden", "light", "evening", "winter", "letter", "music"]) + str(rng.randint(0, 60))
                     for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["buy", "click", "cheap", "win", "$$$", "free"]) + "!" * rng.randint(1, 4) for _ in range(60)) for _ in range(60)]
    item = " ".join(f"question{k}" for k in range(30))
    rows = [(k, t, "en") for k, t in enumerate(good)] + [(100 + k, t, "en") for k, t in enumerate(bad)]
    rows += [(200, good[3] + "\n", "en"), (201, good[3].replace(" ", "\t"), "en"), (202, good[4] + " end", "en"),
             (5, good[6] + " end", "en"), (203, good[7] + " " + item, "en"), (None, good[8], "en"), (None, good[9] + " own words here", "en")]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(60)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs.collect()
    key = lambda t: " ".join((t or "").split())
    quality = kept["quality_classifier"]
    assert not {r.text for r in quality} & set(bad) and {r.text for r in quality} >= set(good)
    exact = kept["exact_dedup"]
    blank = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(blank(r.text) for r in exact) == sorted({blank(r.text) for r in quality})
    assert {r.doc_id for r in exact if blank(r.text) == good[3]} == {3}
    near = {key(r.text) for r in kept["minhash_near_dedup"]}
    for k, other in ((4, " end"), (6, " end"), (9, " own words here")):
        assert len(near & {key(good[k]), key(good[k] + other)}) == 1
    assert len(near) == 61  # 60 good texts, one of them again with the item
    clean = kept["benchmark_decontamination"]
    assert {key(r.text) for r in clean} == {t for t in near if "question7" not in t} and len(clean) == 60
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in clean)
    assert all(r.piece == 0 and r.offset + r.length <= 4096 for r in packed)


def test_clashing_columns_break_no_stage(spark, tmp_path):
    names = ["_row", "_drop_id", "_m_id", "_k_id", "_k_sha", "_k_sha2", "_score_text", "_quality_score", "score", "kept"]
    rng = random.Random(3)
    rows = [(k, words(rng, 40), "en") for k in range(12)]
    rows += [(12, rows[0][1], "en"), (0, rows[1][1], "en"), (13, rows[2][1] + " end", "en")]
    docs_of(spark, rows).withColumns({n: F.lit(n) for n in names}).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(k, int(k < 6)) for k in range(12)], "doc_id long, quality int")
    bench = spark.createDataFrame([("i", rows[5][1])], "item_id string, text string")
    assert quality.accepted(docs, labels, threshold=0.0).count() == len(rows)
    assert quality.accepted(docs, labels, threshold=0.0).columns == docs.columns
    assert quality.quality_predictions(docs, labels).count() == len(rows)
    for part, n in ((exact_dedup.keep_first_texts(docs), 13), (minhash.keep_one_of_each(docs), 12), (decontaminate.without_contaminated(docs, bench), 14)):
        assert part.columns == docs.columns and part.count() == n
        assert part.select(*names).distinct().count() == 1
