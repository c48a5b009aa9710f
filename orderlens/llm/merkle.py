"""Merkle manifest of a table, with proofs obtained by a butterfly exchange.

Rows become leaves; the leaves of a group (a language) form a tree of fanout 8, the
group roots form the top tree. Leaves are placed by a range sort and per-range counts,
and cut into *blocks*: aligned subtrees of 8^3 leaves. What a block hashes by itself
needs no exchange. Above, in round r, the up to 8 blocks whose numbers differ only in
their r-th octal digit swap subtree roots, and each of them hashes the common ancestor
for itself. After the last round every block holds its group's root and all siblings on
the way there, so no pass goes down the tree again. A block whose partner is missing
(the last subtree is not full) is served by another block of that last subtree; a round
sends at most two digests a block.

Defined cases: a null field is written ``-``; null ids and groups sort first; rows with
equal ids follow each other by their leaf, equal rows by their place in the input (their
results are interchangeable); a group with one row has its leaf as root; an empty table
gives no rows; texts count whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.llm.common import materialize, shuffle_partitions

FANOUT = 8
BLOCK_LEVELS = 3
BLOCK = FANOUT**BLOCK_LEVELS

_LEVEL = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """H: sha256 of a text as lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of the fields in order: UTF-8 byte count, ``:``, value; ``-`` if null."""
    parts = []
    for c in fields:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return digest(F.concat(*parts))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda l: F.concat(l["left"], l["right"])), ""))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda node, l: digest(F.concat(l["left"], node, l["right"])))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place in their group ``_g`` (from 0) and the group's size."""
    keys = ["_g", *order]
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *[F.col(c).asc_nulls_first() for c in keys])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    ranged = materialize(ranged.withColumns({
        "_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), "merkle-order")
    # a row per range and group in it; the window of a group has at most a row per range
    runs = ranged.groupBy("_g", "_part").agg(F.count("*").alias("_rows"), F.min("_seq").alias("_first"))
    group = Window.partitionBy("_g")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_g").alias("_run_g"), F.col("_part").alias("_run_part"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(group).alias("_total"))
    here = (F.col("_part") == F.col("_run_part")) & F.col("_g").eqNullSafe(F.col("_run_g"))
    placed = ranged.join(runs, here).withColumn("_pos", F.col("_seq") + F.col("_shift"))
    return placed.drop("_run_g", "_run_part", "_shift", "_part", "_seq")


def _parents(nodes: Column) -> Column:
    """The digests one level up: every 8 consecutive nodes become one."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _levels(count: Column, most: int) -> Column:
    """Levels above ``count`` nodes (0 for a single one), at most ``most``."""
    return sum((F.when(count > FANOUT**k, 1).otherwise(0) for k in range(most)), F.lit(0))


def _blocks(placed: DataFrame, carry: Sequence[str]) -> DataFrame:
    """A row per block: its leaves with what they carry, the node levels inside, its root."""
    member = F.struct(F.col("_pos"), F.col("_leaf"), *[F.col(c) for c in carry])
    out = placed.groupBy("_g", F.floor(F.col("_pos") / BLOCK).cast("long").alias("_block")).agg(
        F.first("_total").alias("_total"), F.sort_array(F.collect_list(member)).alias("_members"))
    out = out.withColumn("_n0", F.transform("_members", lambda m: m["_leaf"]))
    height = _levels(F.col("_total"), BLOCK_LEVELS)
    for k in range(BLOCK_LEVELS):
        below = F.col(f"_n{k}")
        out = out.withColumn(f"_n{k + 1}", F.when(height > k, _parents(below)).otherwise(below))
    return out.withColumns({
        "_height": height, "_root": F.element_at(f"_n{BLOCK_LEVELS}", 1),
        "_blocks": F.ceil(F.col("_total") / BLOCK).cast("long")})


def _butterfly(blocks: DataFrame) -> DataFrame:
    """Per block: the group's root and the siblings of every level above the block."""
    state = blocks.select("_g", "_block", "_blocks", F.col("_root").alias("_node"), F.array().cast(_LEVEL).alias("_up"))
    most = blocks.agg(F.max("_blocks")).first()[0] or 0
    stride = 1
    while stride < most:
        tree = F.floor(F.col("_block") / stride).cast("long")
        low = F.col("_block") % stride
        last = F.floor((F.col("_blocks") - 1) / stride).cast("long")
        width = F.col("_blocks") - last * stride
        # the blocks of a last, smaller subtree also speak for the places it lacks
        serves = F.when((tree == last) & (tree % FANOUT > 0) & (width < stride),
                        F.sequence(low, F.lit(stride - 1).cast("long"), width)).otherwise(F.array(low))
        messages = state.withColumns({"_tree": tree, "_low": low}).withColumn("_slot", F.explode(serves))
        own = F.col("_slot") == F.col("_low")
        message = F.struct(
            F.col("_tree").alias("tree"), F.col("_node").alias("node"),
            F.when(own, F.struct("_block", "_blocks", "_up")).alias("block"))
        met = messages.groupBy("_g", F.floor(F.col("_tree") / FANOUT).cast("long").alias("_run"), "_slot").agg(
            F.sort_array(F.collect_list(message)).alias("_met"))
        met = met.select("_g", "_met", F.explode(F.filter("_met", lambda m: m["block"].isNotNull())).alias("_me"))
        at = F.col("_me.tree")

        def side(keep) -> Column:
            return F.array_join(F.transform(F.filter("_met", keep), lambda m: m["node"]), "")

        level = F.struct(side(lambda m: m["tree"] < at).alias("left"), side(lambda m: m["tree"] > at).alias("right"))
        done = F.col("_me.block._blocks") <= stride
        state = met.withColumn("_side", level).select(
            "_g", F.col("_me.block._block").alias("_block"), F.col("_me.block._blocks").alias("_blocks"),
            F.when(done, F.col("_me.node")).otherwise(
                digest(F.concat("_side.left", "_me.node", "_side.right"))).alias("_node"),
            F.when(done, F.col("_me.block._up")).otherwise(
                F.concat("_me.block._up", F.array("_side"))).alias("_up"))
        stride *= FANOUT
    return state


def _tree(rows: DataFrame, order: Sequence[str], carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of the trees over ``rows`` (``_g``, ``_leaf``, order and carry columns), and per block what is above it."""
    blocks = materialize(_blocks(placed(rows, order), carry), "merkle-blocks")
    return blocks, materialize(_butterfly(blocks), "merkle-above")


def _proofs(blocks: DataFrame, above: DataFrame, carry: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Per leaf: ``_leaf``, carry columns, ``_proof`` up to its block's ``_node``; and the ``extra`` columns of ``above``."""
    above = above.select(F.col("_g").alias("_up_g"), F.col("_block").alias("_up_block"), "_node", "_up", *extra)
    same = (F.col("_block") == F.col("_up_block")) & F.col("_g").eqNullSafe(F.col("_up_g"))

    def inside(i: Column) -> Column:
        levels = []
        for k in range(BLOCK_LEVELS):
            node = F.floor(i / FANOUT**k).cast("int")
            at, run = node % FANOUT, F.floor(node / FANOUT).cast("int") * FANOUT
            nodes = F.col(f"_n{k}")
            levels.append(F.struct(
                F.array_join(F.slice(nodes, run + 1, at), "").alias("left"),
                F.array_join(F.slice(nodes, run + at + 2, FANOUT - 1 - at), "").alias("right")))
        return F.slice(F.array(*levels), F.lit(1), F.col("_height"))

    member = F.transform("_members", lambda m, i: F.struct(
        m["_leaf"].alias("_leaf"), *[m[c].alias(c) for c in carry], F.concat(inside(i), F.col("_up")).alias("_proof")))
    rows = blocks.join(above, same).select("_g", "_node", *extra, F.explode(member).alias("_m"))
    return rows.select("_g", "_node", *extra, "_m.*")


def merkle_proofs(docs: DataFrame, id_col: str, group_col: str, fields: Sequence[str],
                  carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Per row: id, group, leaf, the group's subroot, the table's root and the proof (siblings per level).

    ``carry`` adds columns computed from ``docs``. ``fold(leaf, proof)`` gives the root again.
    """
    carry = dict(carry or {})
    names = [f"_c{i}" for i in range(len(carry))]
    leaves = materialize(docs.select(
        F.col(group_col).alias("_g"), F.col(id_col).alias("_id"), leaf_digest([F.col(c) for c in fields]).alias("_leaf"),
        F.monotonically_increasing_id().alias("_row"), *[c.alias(n) for n, c in zip(names, carry.values())]), "merkle-leaves")
    blocks, above = _tree(leaves, ["_id", "_leaf", "_row"], ["_id", *names])
    subroots = above.filter("_block = 0").select(F.lit(0).alias("_g"), F.col("_g").alias("_group"), F.col("_node").alias("_leaf"))
    top = _proofs(*_tree(subroots, ["_group"], ["_group"]), ["_group"]).select(
        F.col("_group").alias("_top_g"), F.col("_node").alias("_top_root"), F.col("_proof").alias("_top"))
    whole = above.join(top, F.col("_g").eqNullSafe(F.col("_top_g"))).select(
        "_g", "_block", "_node", "_top_root", F.concat("_up", "_top").alias("_up"))
    return _proofs(blocks, whole, ["_id", *names], ["_top_root"]).select(
        F.col("_id").alias(id_col), F.col("_g").alias(group_col), F.col("_leaf").alias("leaf"),
        F.col("_node").alias("subroot"), F.col("_top_root").alias("root"), F.col("_proof").alias("proof"),
        *[F.col(n).alias(a) for n, a in zip(names, carry)])
