"""URL filtering by a Bloom filter cascade.

A rule is a (host, path) pair; as a key it is the host followed by the path. The
keys a url can match are its host and parent domains, of as many labels as a rule's
host has at most, each with the path's prefixes of the lengths that rules have. All such keys of the corpus, distinct,
are the key universe. Level 1 of the cascade is a Bloom filter of the listed
keys; level 2 one of the universe's keys that pass level 1 unlisted; level 3 one
of the listed keys that pass level 2, and so on until a level is empty. For any
key of the universe the cascade answers exactly, with no join. One cascade tells
rules from other keys, a second tells blocked rules from allowed ones.

The filters are sized by the number of listed keys: level 1 lets through about
as many unlisted keys as there are listed ones, so later levels are no larger.

Defined cases: a null url or one without ``://`` has empty host and path and no
rule; a key in both lists is blocked; of rules of one length the one of the longer host
wins; hosts of any number of labels cost as much as their length; repeated urls are judged alike; null ids
pass through; an empty table or list gives no matches; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.common import materialize

MAX_LEVELS = 64
Rule = tuple[str, str]


@dataclass
class Bloom:
    """Bit array and number of hashes; ``salt`` makes levels independent."""

    bits: np.ndarray
    hashes: int
    salt: int

    @classmethod
    def of(cls, keys: list[str], rate: float, salt: int) -> Bloom:
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        out = cls(np.zeros(size, bool), max(1, round(-math.log2(rate))), salt)
        for key in keys:
            out.bits[out._spots(key)] = True
        return out

    def _spots(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), self.salt)
        a, b, n = h >> 64, (h & (2 ** 64 - 1)) | 1, len(self.bits)
        return [(a + i * b) % n for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[s] for s in self._spots(key))


@dataclass
class Cascade:
    """Levels in turn; the first level that lacks a key decides by its place."""

    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def _passing(universe: DataFrame, levels: list[Bloom]) -> DataFrame:
    """Keys of the universe that pass every level."""
    shared = universe.sparkSession.sparkContext.broadcast(levels)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [all(k in level for level in shared.value) for k in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return universe.select("key").mapInArrow(passing, "key string")


def build_cascade(listed: Iterable[str], universe: DataFrame) -> Cascade:
    """A cascade exact on ``universe`` (column ``key``, distinct) and on the listed keys.

    Listed keys are the rule list, which the caller holds; unlisted keys that a
    level lets through come back from the corpus, about as many as are listed.
    """
    inside = sorted(set(listed))
    if not inside:
        return Cascade()
    members = set(inside)
    ratio = max(2.0, universe.count() / len(inside))
    cascade = Cascade([Bloom.of(inside, min(0.5, 1.0 / ratio), 0)])
    outside = [r["key"] for r in _passing(universe, cascade.levels).toLocalIterator() if r["key"] not in members]
    current, other = sorted(outside), inside
    while current:
        if len(cascade.levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = Bloom.of(current, 0.5, len(cascade.levels))
        cascade.levels.append(level)
        current, other = [k for k in other if k in level], current
    return cascade


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path as the url has them; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int], most_labels: int) -> Column:
    """Keys a url can match, longest first by host, then by path; hosts of ``most_labels`` at most."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(path_lengths, reverse=True)])
    prefixes = F.array_compact(prefixes)
    keys = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, allow: list[Rule], block: list[Rule], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Id, host, path, the longest rule that fits (or null) and the verdict."""
    blocked = {h + p for h, p in block}
    listed = blocked | {h + p for h, p in allow}
    lengths = sorted({len(p) for _, p in [*allow, *block]})
    most_labels = max((h.count(".") + 1 for h, _ in [*allow, *block]), default=1)
    host, path = url_parts(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths, most_labels))
    universe = materialize(keyed.select(F.explode("_keys").alias("key")).distinct(), "keys")
    rules = build_cascade(listed, universe)
    bad = build_cascade(blocked, universe.sparkSession.createDataFrame([(k,) for k in sorted(listed)], "key string"))
    shared = pages.sparkSession.sparkContext.broadcast((rules, bad))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_set, bad_set = shared.value
        for batch in batches:
            found = [max((k for k in row if k in rule_set), key=len, default=None)
                     for row in batch.column(3).to_pylist()]
            verdict = [default if k is None else "block" if k in bad_set else "allow" for k in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string()),
                                              pa.array(verdict, pa.string())],
                                             names=["_id", "host", "path", "rule", "verdict"])

    kind = parts.schema["_id"].dataType.simpleString()
    judged = keyed.mapInArrow(match, f"_id {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("_id", id_col)
