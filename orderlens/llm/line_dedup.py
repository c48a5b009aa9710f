"""Line dedup by a segment-partition edit join (DataFrame functions only).

Lines of all documents within ``threshold`` edits of each other, and not over a fifth of
the longer one's characters, are linked. Going through the distinct lines by their first
place, a line stays unless it is linked to one that stays: so every line that goes has a like
one that stays, and lines are not chained away. Each distinct line is cut into threshold + 1 segments of nearly equal length; a line
within the threshold holds one of them unchanged, close to its place. So lines
index their segments by (length, segment number, content hash), and probe, for
each partner length from their own down to threshold less, the substrings that
the multi-match-aware rule selects. Candidates are verified by bit-parallel edit
distance over a diagonal band of 2 x threshold + 1 cells, in integer columns.

Entries and probes carry counts of eight letters; an edit moves at most two of
them by one (in lines of one length the rest of the line counts too), so the join's
own condition drops pairs whose counts are too far apart, and groups of lines with
a common segment do not come out as all pairs.
Work is on distinct lines: a line in every document is one row. Line ids are
64-bit hashes; lines that share one would be one class (n^2 / 2^65 for n lines).
Which lines stay is worked out in rounds on tables, not on the driver.

Defined cases: lines are what stands between line feeds, with ASCII white space
trimmed at both ends; empty lines are neither linked nor repeated; a null text
has no lines; lines up to ``threshold`` characters have empty segments and are
compared only for equality; every input row is a document of its own, also with a
null or repeated id; of a line that stays the smallest (document id, row, line
number) does, null ids last; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.common import materialize

THRESHOLD = 2
SIMILARITY = 0.8
LETTERS = "eantiosr"


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, line number from 0, trimmed text and 64-bit id of every non-empty line."""
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    lines = text.select("_id", F.posexplode_outer(F.split("_text", "\n")).alias("line_no", "_raw"))
    trimmed = lines.select("_id", "line_no", F.btrim("_raw", F.lit(" \t\n\x0b\f\r")).alias("line"))
    return trimmed.filter("line != ''").withColumn("id", F.xxhash64("line"))


def document_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (a key of the input row), ``_id``, line number and id of every non-empty line, written as a table.

    A row whose first line is empty has it too, with a null id, so that every input row is there.
    """
    text = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
                       F.col(text_col).cast("string").alias("_text"))
    lines = text.select("_row", "_id", F.posexplode_outer(F.split("_text", "\n")).alias("line_no", "_raw"))
    trimmed = lines.select("_row", "_id", "line_no", F.btrim("_raw", F.lit(" \t\n\x0b\f\r")).alias("line"))
    placed = trimmed.select("_row", "_id", "line_no", F.when(F.col("line") != "", F.xxhash64("line")).alias("id"))
    return materialize(placed.filter("id is not null or coalesce(line_no, 0) = 0"), "line-places")


def letter_counts(line: Column) -> Column:
    """Counts of eight letters, four bits each (modulo 16)."""
    size = F.octet_length(line)
    out = F.lit(0)
    for k, letter in enumerate(LETTERS):
        n = size - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15)), 4 * k))
    return out


def counts_apart(a: Column, b: Column, same_length: bool) -> Column:
    """A lower bound of the sum of differences of the letter counts.

    In lines of one length the other characters differ by what the letters do not make up
    for, so that difference is added.
    """
    total, surplus = F.lit(0), F.lit(0)
    for k in range(len(LETTERS)):
        gap = (F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15))
               - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)))
        total, surplus = total + _modulo_16(gap), surplus + gap
    return total + _modulo_16(surplus) if same_length else total


def _modulo_16(gap: Column) -> Column:
    rest = F.abs(gap) % 16
    return F.least(rest, F.lit(16) - rest)


def places(threshold: int) -> list[tuple[int, int, int]]:
    """(characters that the partner is shorter by, its segment, places to the right) of the substrings to probe.

    Segment k (from 0) at place p of a partner shorter by d can stand at p - k .. p + k
    from the left and at p + d - (threshold - k) .. p + d + (threshold - k) from the
    right; both must hold.
    """
    return [(d, k, move) for d in range(threshold + 1) for k in range(threshold + 1)
            for move in range(max(-k, d - (threshold - k)), min(k, d + threshold - k) + 1)]


def segment_hashes(lines: DataFrame, at: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """Hash of (partner length, segment number, content) for the substrings of each line at the given places.

    A line of n characters has threshold + 1 segments of n / (threshold + 1) characters,
    the last ones one longer. Places are rows, so the expressions stay small; ``code`` has
    four bytes a character, so a substring is a slice and not a walk over characters.
    """
    parts = threshold + 1
    spots = F.array(*[F.struct(F.lit(d).alias("shorter"), F.lit(k).alias("k"), F.lit(m).alias("move")) for d, k, m in at])
    each = lines.select("id", "counts", "code", "len", F.explode(spots).alias("s")).select("id", "counts", "code", "len", "s.*")
    each = each.withColumn("partner", F.col("len") - F.col("shorter"))
    each = each.withColumn("short", F.floor(F.col("partner") / parts).cast("int")).withColumn("over", F.col("partner") % parts)
    size = F.col("short") + (F.col("over") >= parts - F.col("k")).cast("int")
    start = F.col("k") * F.col("short") + F.greatest(F.lit(0), F.col("over") + F.col("k") - parts) + F.col("move")
    each = each.withColumn("size", size).withColumn("start", start).filter(
        (F.col("partner") >= parts) & (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("len")))
    content = F.substr("code", 4 * F.col("start") + 1, 4 * F.col("size"))
    return each.select(F.xxhash64("partner", "k", content).alias("h"), "id", "counts")


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two character arrays by bit-parallel rows over a band of 2 x threshold + 1 diagonals.

    Above the threshold it is threshold + 1. ``reach[e]`` is a bit set of diagonals: the
    bit d is set if the first i characters of ``a`` and i + d - threshold of ``b`` are
    within e edits. One step takes all diagonals at once by shifts and masks; ``same``
    has the diagonals whose next characters are equal.
    """
    band = 2 * threshold + 1
    full = (1 << band) - 1
    n, m = F.size(a), F.size(b)

    def close(rows: list[Column]) -> list[Column]:
        """Insertions along a row: from e edits at d to e + 1 edits at d + 1."""
        out = [rows[0]]
        for e in range(1, threshold + 1):
            out.append(rows[e].bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(F.lit(full)))
        return out

    def state(rows: list[Column]) -> Column:
        return F.struct(*[r.cast("int").alias(f"r{e}") for e, r in enumerate(rows)])

    start = close([F.lit(1 << threshold)] * (threshold + 1))

    def step(acc: Column, i: Column) -> Column:
        same = reduce(lambda x, y: x.bitwiseOR(y), [
            F.when(F.get(b, i + d - threshold) == F.get(a, i), 1 << d).otherwise(0) for d in range(band)])
        old = [acc[f"r{e}"] for e in range(threshold + 1)]
        rows = []
        for e in range(threshold + 1):
            row = old[e].bitwiseAND(same)
            if e:
                row = row.bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1))
            rows.append(row)
        return state(close(rows))

    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, state(start), step)
    goal = F.call_function("shiftleft", F.lit(1), m - n + threshold)
    out = F.lit(threshold + 1)
    for e in range(threshold, -1, -1):
        out = F.when(last[f"r{e}"].bitwiseAND(goal) != 0, e).otherwise(out)
    return F.when(F.abs(m - n) > threshold, threshold + 1).otherwise(out)


def linked_lines(docs: DataFrame, id_col: str, text_col: str, threshold: int, similarity: float) -> DataFrame:
    """Links (a, b) between the ids of all distinct lines within the threshold of each other and alike enough.

    One plan: distinct lines are shuffled by id once; entries, probes and the two
    joins that fetch the texts of candidates reuse that exchange.
    """
    lines = document_lines(docs, id_col, text_col).groupBy("id").agg(F.any_value("line").alias("line"))
    lines = lines.withColumn("len", F.length("line")).filter(F.col("len") > threshold)
    coded = lines.select("id", "len", F.encode("line", "UTF-32").alias("code"), letter_counts(F.col("line")).alias("counts"))
    own = [(0, k, 0) for k in range(threshold + 1)]
    index = segment_hashes(coded, own, threshold)
    probes = segment_hashes(coded, [p for p in places(threshold) if p not in own], threshold)

    def meet(others: DataFrame, once: Column, same_length: bool) -> DataFrame:
        x = index.select("h", F.col("id").alias("a"), F.col("counts").alias("ca"))
        y = others.select("h", F.col("id").alias("b"), F.col("counts").alias("cb"))
        near = counts_apart(F.col("ca"), F.col("cb"), same_length) <= 2 * threshold
        return x.join(y, (x["h"] == y["h"]) & once & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    in_place = meet(index, F.col("a") < F.col("b"), True)
    moved = meet(probes, F.col("a") != F.col("b"), False)
    pairs = in_place.union(moved).distinct()
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("la"))
    right = lines.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    # a bounded distance of the engine drops most candidates before characters are laid out
    close = F.levenshtein("la", "lb", threshold) >= 0
    most = F.floor(F.greatest(F.length("la"), F.length("lb")) * (1 - similarity) + 1e-9).alias("most")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb", most).filter((F.col("most") > 0) & close).select(
        "a", "b", "most", characters(F.col("la")).alias("xa"), characters(F.col("lb")).alias("xb"))
    # generators keep the optimizer from putting the character arrays into every step
    distance = F.explode_outer(F.array(banded_distance(F.col("xa"), F.col("xb"), threshold))).alias("distance")
    return both.select("a", "b", "most", distance).filter(
        F.col("distance") <= F.least(F.col("most"), F.lit(threshold))).select("a", "b")


def lines_that_go(links: DataFrame, places: DataFrame) -> DataFrame:
    """Ids of the lines that are linked to a line that stays, of lines in the order of ``first`` (``id``, ``first``).

    Links run from an earlier to a later line. Each round the lines that no open link
    leads to stay, the lines they lead to go, and the links of these are done with;
    the first line of the open links always stays, so the rounds end.
    """
    at_a = places.select(F.col("id").alias("a"), F.col("first").alias("fa"))
    at_b = places.select(F.col("id").alias("b"), F.col("first").alias("fb"))
    both = links.join(at_a, "a").join(at_b, "b")
    before = F.col("fa") < F.col("fb")
    open_ = materialize(both.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("low"),
                                    F.when(before, F.col("b")).otherwise(F.col("a")).alias("high")), "line-order")
    gone = []
    while not open_.isEmpty():
        led_to = open_.select(F.col("high").alias("line")).distinct()
        stay = open_.join(led_to, F.col("low") == F.col("line"), "left_anti")
        gone.append(materialize(stay.select(F.col("high").alias("id")).distinct(), "lines-gone"))
        high, low = gone[-1].select(F.col("id").alias("high")), gone[-1].select(F.col("id").alias("low"))
        open_ = materialize(open_.join(high, "high", "left_anti").join(low, "low", "left_anti").select("low", "high"), "line-order")
    return reduce(DataFrame.unionByName, gone) if gone else open_.select(F.col("low").alias("id"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: int = THRESHOLD, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: lines, removed lines and their numbers."""
    links = materialize(linked_lines(docs, id_col, text_col, threshold, similarity), "line-links")
    places = document_places(docs, id_col, text_col)
    lines = places.filter("id is not null")
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"),
                     F.col("line_no").alias("line_no"))
    by_id = lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    by_id = materialize(by_id, "line-ids")
    goes = lines_that_go(links, by_id).withColumn("goes", F.lit(True))
    repeated = by_id.join(goes, "id", "left").filter("n > 1 or goes").select(
        "id", F.col("first.row").alias("first_row"), F.col("first.line_no").alias("first_line"),
        F.coalesce("goes", F.lit(False)).alias("goes"))
    repeated = materialize(repeated, "line-repeats")
    judged = lines.join(repeated, "id", "left")
    away = F.col("goes") | (F.col("first_row") != F.col("_row")) | (F.col("first_line") != F.col("line_no"))
    judged = judged.select("_row", "_id", F.lit(1).alias("line"), F.when(away, F.col("line_no")).alias("removed"))
    none = places.filter("id is null").select("_row", "_id", F.lit(0).alias("line"), F.lit(None).cast("int").alias("removed"))
    per_row = judged.union(none).groupBy("_row").agg(
        F.any_value("_id").alias(id_col), F.sum("line").alias("n_lines"),
        F.array_sort(F.collect_list("removed")).alias("removed_lines"))
    return per_row.select(id_col, "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
