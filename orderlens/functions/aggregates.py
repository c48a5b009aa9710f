"""Aggregate building blocks that stay distributed at any group size."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mode_or_unknown(x: str | Column) -> Column:
    """Most frequent non-null label; ties go to the smallest label; none -> 'Unknown'.

    ``mode`` keeps a value->count map per group and merges partial maps, so a
    hot group costs one map entry per distinct label, not one row per item.
    """
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.mode(c.cast(T.StringType()), deterministic=True), F.lit("Unknown"))


# Ranges a pass cuts the open range of a wanted rank into, and bits of the ordered value.
RANGES = 1 << 14
_BITS = 64
_COUNTED_AT_ONCE = 1 << 17  # rows that a task counts together


def _bits_of(value: np.ndarray) -> np.ndarray:
    """The bits of doubles as longs in their order: negative ones below 0, -0 as 0, NaN above all."""
    size = np.where(np.isnan(value), (2047 << 52) + 1, np.abs(value).view(np.int64))
    return np.where(value < 0, -1 - size, size)


@F.arrow_udf(returnType=T.LongType())
def _double_bits(x: pa.Array) -> pa.Array:
    """``_bits_of`` a column; as a column expression their branches are too long to be compiled."""
    value = x.fill_null(0.0).to_numpy(zero_copy_only=False)
    return pa.array(_bits_of(value), mask=x.is_null().to_numpy(zero_copy_only=False))


def ordered_bits(x: Column, kind: T.DataType) -> Column:
    """A long in the order of the values of ``x`` (integers as they are, doubles by their bits; -0 is 0)."""
    if isinstance(kind, T.IntegralType):
        return x.cast(T.LongType())
    return _double_bits(x.cast(T.DoubleType()))


def _value_of(bits: int, kind: T.DataType) -> int | float:
    """The value that ``ordered_bits`` maps to ``bits``."""
    if isinstance(kind, T.IntegralType):
        return bits
    size = struct.unpack(">d", struct.pack(">q", bits if bits >= 0 else -1 - bits))[0]
    return size if bits >= 0 else -size


@dataclass
class _Search:
    """The range of ordered values, ends included, that holds a wanted rank, and the rank inside it."""

    low: int
    high: int
    rank: int

    def narrow(self, span: tuple[int, int, int], counts: Iterable[tuple[int, int]]) -> None:
        """Keep the part of the range ``span`` (its ends and shift) that holds the rank; ``counts`` has (part, rows) in order."""
        low, high, shift = span
        for part, rows in counts:
            if self.rank < rows:
                self.low, self.high = max(low, part << shift), min(high, ((part + 1) << shift) - 1)
                break
            self.rank -= rows

    @property
    def shift(self) -> int:
        """Bits to drop so that the range has at most ``RANGES`` parts."""
        for bits in range(_BITS):
            if (self.high >> bits) - (self.low >> bits) < RANGES:
                return bits
        return _BITS - 1


def range_counts(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of ``values`` (``_g``, ``_v``) per part of each open range: at most ``RANGES`` rows a range.

    ``ranges`` (``_range``, ``_range_g``, ``low``, ``high``, ``shift``) has a row per group and
    wanted rank, so it is broadcast; counts are added up before the shuffle.
    """
    here = F.col("_g").eqNullSafe(F.col("_range_g")) & F.col("_v").between(F.col("low"), F.col("high"))
    part = F.expr("shiftright(_v, shift)").alias("part")
    return values.join(F.broadcast(ranges), here).groupBy("_range", part).agg(F.count("*").alias("rows"))


def values_at_ranks(
    df: DataFrame,
    value: str,
    ranks: dict[str, Callable[[int], int]],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Exact order statistics per group by radix selection: no sort, no sketch, no group in one task.

    ``ranks`` maps an output name to a function of the group's non-null count ``n``
    giving a 0-based ascending rank. One scan counts each group and finds its smallest
    and largest value. Each further scan counts the rows in up to 2^14 equal parts (of the
    ordered bits) of every range that holds a wanted rank, and keeps the part that
    holds it, until that is one value: at most five scans for any 64-bit values, two or three as a
    rule. What is shuffled and read by the driver is a count per part, never values.

    One row per group: the group columns, ``n``, and a column per rank (null if the rank
    is outside 0 .. n - 1). Callers pass only a small, bounded set of groups.
    """
    spark, kind = df.sparkSession, df.schema[value].dataType
    keys = F.struct(*[F.col(g) for g in groups]) if groups else F.lit(0)
    values = df.select(F.to_json(keys).alias("_g") if groups else keys.cast("string").alias("_g"), *groups,
                       ordered_bits(F.col(value), kind).alias("_v")).where(F.col(value).isNotNull())
    found = values.groupBy("_g", *groups).agg(
        F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
    open_: dict[tuple[str, str], _Search] = {}
    for r in found:
        for name, rank in ranks.items():
            if 0 <= rank(r["n"]) < r["n"]:
                open_[r["_g"], name] = _Search(r["low"], r["high"], rank(r["n"]))
    searches = dict(open_)
    while open_ := {k: s for k, s in open_.items() if s.low < s.high}:
        spans = sorted({(g, s.low, s.high, s.shift) for (g, _), s in open_.items()})
        ranges = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)],
                                       "_range int, _range_g string, low long, high long, shift int")
        counts: dict[int, list] = {}
        for r in range_counts(values, ranges).orderBy("_range", "part").collect():
            counts.setdefault(r["_range"], []).append((r["part"], r["rows"]))
        for (g, _), s in open_.items():
            span = (g, s.low, s.high, s.shift)
            s.narrow(span[1:], counts[spans.index(span)])
    rows = []
    for r in found:
        at = [searches.get((r["_g"], name)) for name in ranks]
        rows.append((*[r[g] for g in groups], r["n"], *[None if s is None else _value_of(s.low, kind) for s in at]))
    schema = T.StructType([*[df.schema[g] for g in groups], T.StructField("n", T.LongType()),
                           *[T.StructField(name, kind) for name in ranks]])
    return spark.createDataFrame(rows, schema)


MEDIAN_RANKS = {"_m_lo": lambda n: (n - 1) // 2, "_m_hi": lambda n: n // 2}


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row ``(n, median)``: interpolated median of a numeric column, nulls skipped."""
    picked = values_at_ranks(df.select(F.col(value).cast(T.DoubleType()).alias(value)), value, MEDIAN_RANKS)
    return picked.select("n", ((F.col("_m_lo") + F.col("_m_hi")) / 2).alias("median"))


def column_range_counts(df: DataFrame, ranges: list[tuple[str, int, int, int]]) -> DataFrame:
    """``range_counts`` of columns of doubles side by side: ``ranges`` has (column, low, high, shift).

    A task counts its batches in one array a range, so no row is made per value, and at most ``RANGES`` rows a
    range and task are shuffled.
    """
    columns = list(dict.fromkeys(c for c, *_ in ranges))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((high >> shift) - (low >> shift) + 1, np.int64) for _, low, high, shift in ranges]
        held: list[pa.RecordBatch] = []

        def add() -> None:
            table = pa.Table.from_batches(held)
            bits = {c: _bits_of(table[c].drop_null().to_numpy()) for c in columns}
            for out, (c, low, high, shift) in zip(counts, ranges):
                here = bits[c][(bits[c] >= low) & (bits[c] <= high)]
                out += np.bincount((here >> shift) - (low >> shift), minlength=len(out))

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= _COUNTED_AT_ONCE:
                add()
                held = []
        if held:
            add()
        for i, (out, (_, low, _, shift)) in enumerate(zip(counts, ranges)):
            part = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int32)), pa.array(part + (low >> shift)), pa.array(out[part])],
                                             names=["_range", "part", "rows"])

    counted = df.select(*columns).mapInArrow(count, "_range int, part long, rows long")
    return counted.groupBy("_range", "part").agg(F.sum("rows").alias("rows"))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column ``(column, n, median)`` from a single set of passes.

    The search of ``values_at_ranks``, with the columns side by side instead of a row per column and value.
    """
    doubles = df.select(*[F.col(c).cast(T.DoubleType()).alias(c) for c in columns])
    found = doubles.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns]).first()
    searches: dict[tuple[str, str], _Search] = {}
    for c in columns:
        if n := found[c]["n"]:
            low, high = _bits_of(np.array([found[c]["low"], found[c]["high"]])).tolist()
            searches |= {(c, name): _Search(low, high, rank(n)) for name, rank in MEDIAN_RANKS.items()}
    while open_ := {k: s for k, s in searches.items() if s.low < s.high}:
        spans = sorted({(c, s.low, s.high, s.shift) for (c, _), s in open_.items()})
        counts: dict[int, list] = {}
        for r in sorted(column_range_counts(doubles, spans).collect()):  # at most RANGES rows a range
            counts.setdefault(r["_range"], []).append((r["part"], r["rows"]))
        for (c, _), s in open_.items():
            span = (c, s.low, s.high, s.shift)
            s.narrow(span[1:], counts[spans.index(span)])
    kind, rows = T.DoubleType(), []
    for c in columns:
        if found[c]["n"]:
            low, high = (_value_of(searches[c, name].low, kind) for name in MEDIAN_RANKS)
            rows.append((c, found[c]["n"], (low + high) / 2))
    return df.sparkSession.createDataFrame(rows, "column string, n long, median double")


def exact_medians_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``exact_medians`` pivoted to one row: a ``median`` column per input column."""
    meds = exact_medians(df, columns)
    return meds.groupBy().pivot("column", list(columns)).agg(F.first("median"))
