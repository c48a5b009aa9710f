"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is normalised, cut into chunks where its content has a sentence end, and
written as its *recipe*: the ordered list of chunk identifiers. Each distinct chunk text moves once, after
map-side de-duplication, to prove that no two different chunks share an
identifier; if two do, identifiers get one more hash and the proof is repeated.
Equal recipes are then equal texts, and only recipes are grouped and joined.

Defined cases: a null text counts as empty; empty texts form one group; a null
id loses against any other id; of repeated rows (same id, same text) exactly one
is kept; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.llm.common import free_name, materialize

# A chunk ends after a sentence end (its content decides), 256 to 2048 characters long;
# 2048 characters without one are a chunk as they stand.
CHUNK = r"(?s).{255,2046}?[.!?。！？؟।…]\x20?|.{1,2048}"
_SEEDS = (0x51ED27, 0x2F0B4C, 0x77A1D9, 0x1C6E83, 0x63B5F1, 0x0A94E7, 0x3D7C29, 0x48F613)


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def chunk_list(text: Column) -> Column:
    """Chunks of a normalised text; laid end to end they give the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_id(chunk: Column, width: int, bits: int = 64) -> Column:
    """``width`` seeded hashes of a chunk, each cut to ``bits`` (fewer only to test collisions)."""
    parts = [F.xxhash64(F.lit(seed), chunk) for seed in _SEEDS[:width]]
    return F.array(*[F.shiftrightunsigned(p, 64 - bits) if bits < 64 else p for p in parts])


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    return text.select("_id", "_text", chunk_list(F.col("_text")).alias("_chunks"))


def verified_width(chunked: DataFrame, width: int, bits: int) -> int:
    """The smallest number of hashes, from ``width`` on, that tells all distinct chunks apart."""
    while True:
        # the outer form: a plain explode infers a filter that would cut every text twice
        chunk = chunked.select(F.explode_outer("_chunks").alias("c"))
        distinct = chunk.select(chunk_id(F.col("c"), width, bits).alias("id"), "c").distinct()
        shared = distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
        if shared.isEmpty():
            return width
        if width == len(_SEEDS):
            raise RuntimeError("distinct chunks share all hashes")
        width += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = 2, bits: int = 64) -> DataFrame:
    """One row per document: id, id that stays, group size, whether it is kept, sha256 of the text."""
    chunked = _chunked(docs, id_col, text_col)
    width = verified_width(chunked, width, bits)
    recipes = materialize(chunked.select(
        "_id",
        F.monotonically_increasing_id().alias("_row"),
        F.flatten(F.transform("_chunks", lambda c: chunk_id(c, width, bits))).alias("_recipe"),
        F.sha2(F.col("_text"), 256).alias("_sha")), "recipes")
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = materialize(
        recipes.groupBy("_recipe").agg(F.min(order).alias("_keep"), F.count("*").alias("_n")).filter("_n > 1"),
        "groups")
    joined = recipes.join(groups, "_recipe", "left")
    single = F.col("_n").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("_keep.row") == F.col("_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def keep_first_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with their columns.

    Ids none of whose rows stay are dropped by an anti join on the id. Only ids
    that have kept and dropped rows (repeated ids) look at their texts again.
    """
    marks = materialize(exact_dedup(docs, id_col, text_col), "marks")
    m_id, k_id, k_sha, sha = (free_name(docs, c) for c in ("_m_id", "_k_id", "_k_sha", "_k_sha2"))
    by_id = marks.groupBy(F.col(id_col).alias(m_id)).agg(
        F.count("*").alias("_rows"), F.sum(F.col("kept").cast("long")).alias("_stay"))
    same = F.col(id_col).eqNullSafe(F.col(m_id))
    whole = docs.join(by_id.filter("_stay < _rows").select(m_id), same, "left_anti")
    mixed = by_id.filter("_stay > 0 and _stay < _rows").select(m_id)
    stay = marks.filter("kept").select(F.col(id_col).alias(k_id), F.col("text_sha256").alias(k_sha))
    again = docs.join(mixed, same, "left_semi").withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    again = again.join(stay, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(sha) == F.col(k_sha)),
                       "left_semi").dropDuplicates([id_col, sha])
    return whole.select(*docs.columns).unionByName(again.select(*docs.columns))
