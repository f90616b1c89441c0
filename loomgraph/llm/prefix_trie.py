"""Conversation prefix trie: digest-keyed nodes, rolled up by pointer jumping, with DataFrame functions but for one digest.

Turns become a digest and a length; a node is a sequence of turns from the start and its key a digest of it. A prefix's
key comes from a sum of hashes of (place, turn), so keys of one conversation are prefix sums: rows are dealt by ranges
of (conversation, turn), numbered and summed within a range, and shifted by what the ranges before hold. A conversation
with any number of turns thus spreads over tasks. A row knows its node's key and its parent's, which gives the edges.

Nodes that one conversation alone reaches need no rollup: below them nothing is shared and there is one leaf. The others
add up leaves and savings by doubling: in round i each node holds the sums of what lies fewer than 2^i levels below
and a pointer to its ancestor 2^i levels above; sums go to that ancestor and the pointer jumps on. That takes as many
rounds as the depth of shared nodes has binary digits. Sums combine before they shuffle; each side that a jump is looked
up in has one row for each key and is written before, so Spark can split a pointer that many nodes share.

Ids that end in one node are joined in blocks of at most ``BLOCK`` (an id is whole and stands once) before any shuffle
by node; a node's blocks then stream through SHA-256, which can't be split, in order.

Defined cases: turns of a null conversation are left out; turns are ordered by number (null first), then role, then
SHA-256 of the text, and repeated turns stay; a null role or text is empty; an empty table has no root and gives an empty
result; other columns are ignored. For negative ids ``c % 100`` has the sign of c, as in SQL.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, trimmed

BLOCK = 512
_LIMBS = [f"_l{i}" for i in range(4)]


def _hashes(place) -> list:
    """Four numbers of 32 bits that stand for a turn at a place; their sums over a prefix can't overflow."""
    two = [F.xxhash64(F.lit(seed), place, "_turn") for seed in (17, 71)]
    return [x for h in two for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def _key(depth, sums) -> F.Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, *sums)))


def _before(rows: DataFrame, sums: dict[str, F.Column]) -> DataFrame:
    """_c, _seg and, for each sum, what the segments before hold; a conversation has at most as many segments as there are partitions, and one."""
    earlier = Window.partitionBy("_c").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("_c", "_seg").agg(*(e.alias(f"_own{n}") for n, e in sums.items())).select("_c", "_seg", *(F.coalesce(F.sum(f"_own{n}").over(earlier), F.lit(0)).alias(n) for n in sums))


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """_c, _seg (the range it fell in), _p (place in its conversation, from 1), _turn (digest of role and text), _len (code points of the text)."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("_c"), F.col(f"`{turn_col}`").alias("_t"), role.alias("_r"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_d"), F.length(text).cast("long").alias("_len"))
    order = ["_t", "_r", "_d", "_n"]  # the last deals out turns that are equal in all the others
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_c", *order).withColumn("_seg", F.spark_partition_id())
    dealt = staged(dealt.withColumn("_turn", F.unhex(F.md5(F.concat(F.length("_r").cast("string"), F.lit(":"), F.col("_r"), F.hex("_d"))))), "turns")
    shift = _before(dealt, {"_first": F.count("*")})
    place = Window.partitionBy("_c", "_seg").orderBy(*order)
    return dealt.withColumn("_k", F.row_number().over(place)).join(shift, ["_c", "_seg"]).select("_c", "_seg", (F.col("_first") + F.col("_k")).alias("_p"), "_turn", "_len")


def rebuilt(turns: DataFrame, spread: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rows as of ``numbered`` for conversations whose head comes from another one, and the conversations (_c, _total turns).

    Conversation c begins with the first h turns of c - c % spread (all if there are fewer), h = crc32(decimal c) % heads,
    and goes on with its own after its first h. A row of another conversation is copied fewer than ``spread`` times.
    """
    head = F.crc32(F.col("_c").cast("string").cast("binary")) % heads
    lens = staged(turns.groupBy("_c").agg(F.max("_p").alias("_own")).select("_c", "_own", head.alias("_h"), (F.col("_c") - F.col("_c") % spread).alias("_b")), "lengths")
    plan = lens.join(lens.select(F.col("_c").alias("_b"), F.col("_own").alias("_there")), "_b", "left").withColumn("_k", F.least("_h", F.coalesce("_there", F.lit(0))))
    plan = staged(plan.select("_c", "_b", "_h", "_k", (F.col("_k") + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))).alias("_total")), "heads")
    own = turns.join(plan.select("_c", "_h", "_k"), "_c").filter("_p > _h").select("_c", "_seg", (F.col("_p") - F.col("_h") + F.col("_k")).alias("_p"), "_turn", "_len")
    firsts = turns.filter((F.col("_c") % spread == 0) & (F.col("_p") < heads)).select(F.col("_c").alias("_b"), "_p", "_turn", "_len")
    lent = plan.filter("_k > 0").join(firsts, "_b").filter("_p <= _k").select("_c", F.lit(-1).alias("_seg"), "_p", "_turn", "_len")
    return own.unionByName(lent), plan.select("_c", "_total")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and prefix, the empty one too: _c, _depth, _key, _parent (null at the root), _len of the last text, _end (it is the whole conversation)."""
    rows = staged(turns.select("_c", "_seg", "_p", "_len", *(h.alias(n) for h, n in zip(_hashes(F.col("_p")), _LIMBS, strict=True))), "limbs")
    upto = Window.partitionBy("_c", "_seg").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = _before(rows, {f"{n}b": F.sum(n) for n in _LIMBS})
    sums = rows.select("*", *(F.sum(n).over(upto).alias(f"{n}s") for n in _LIMBS)).join(shift, ["_c", "_seg"])
    here = [F.col(f"{n}s") + F.col(f"{n}b") for n in _LIMBS]
    above = [h - F.col(n) for h, n in zip(here, _LIMBS, strict=True)]
    root = _key(F.lit(0), [F.lit(0)] * len(_LIMBS))
    below = sums.select("_c", F.col("_p").alias("_depth"), _key(F.col("_p"), here).alias("_key"), _key(F.col("_p") - 1, above).alias("_parent"), "_len").join(convs, "_c")
    top = convs.select("_c", F.lit(0).cast("long").alias("_depth"), root.alias("_key"), F.lit(None).cast("binary").alias("_parent"), F.lit(0).cast("long").alias("_len"), "_total")
    return staged(below.select(*top.columns).unionByName(top).withColumn("_end", F.col("_depth") == F.col("_total")).drop("_total"), "paths")


def ends(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """_key, ends_sha256 of each node where a conversation ends."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_c")), lambda c: c.cast("string")), ",")
    blocks = staged(rows.filter("_end").groupBy("_key", F.floor(F.col("_c") / block).alias("_block")).agg(joined.alias("_ids")), "end-blocks")
    schema = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])

    def run(batches):
        key, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        sums.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], ["_key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["_key", "ends_sha256"])

    return blocks.repartition("_key").sortWithinPartitions("_key", "_block").select("_key", "_ids").mapInArrow(trimmed(run), schema)


def rolled_up(nodes: DataFrame) -> DataFrame:
    """_key, _leaves, _saved summed over each node's subtree, given _key, _parent, _depth and each node's own _leaves and _saved; parents must be among the nodes."""
    state = staged(nodes.select("_key", "_depth", F.col("_parent").alias("_up"), "_leaves", "_saved"), "jump")
    deepest = state.agg(F.max("_depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        sent = state.filter(F.col("_depth") >= step).groupBy(F.col("_up").alias("_key")).agg(F.sum("_leaves").alias("_more_leaves"), F.sum("_saved").alias("_more_saved"))
        added = state.join(sent, "_key", "left").withColumn("_leaves", F.col("_leaves") + F.coalesce("_more_leaves", F.lit(0))).withColumn("_saved", F.col("_saved") + F.coalesce("_more_saved", F.lit(0)))
        added = added.select("_key", "_depth", "_up", "_leaves", "_saved")
        if 2 * step <= deepest:  # pointers that end at the root or above it jump no more, so it is never looked up
            jumps = state.filter(F.col("_depth") >= step).select(F.col("_key").alias("_up"), F.col("_up").alias("_next"))
            far = added.filter(F.col("_depth") >= 2 * step).join(jumps, "_up").select("_key", "_depth", F.col("_next").alias("_up"), "_leaves", "_saved")
            added = far.unionByName(added.filter(F.col("_depth") < 2 * step))
        state, step = staged(added, "jump"), 2 * step
    return state.select("_key", "_leaves", "_saved")


def trie(rows: DataFrame) -> DataFrame:
    """One row per node of ``paths``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = staged(rows.groupBy("_key").agg(F.min("_c").alias("conv_id"), F.first("_depth").alias("_depth"), F.first("_parent").alias("_parent"), F.count("*").alias("n_convs"), F.max("_len").alias("_len")), "nodes")
    under = staged(nodes.filter("_depth > 0").groupBy(F.col("_parent").alias("_key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("_alone")), "children")
    nodes = staged(nodes.join(under, "_key", "left").na.fill(0, ["n_children", "_alone"]).join(ends(rows), "_key", "left"), "nodes")
    shared = nodes.filter("n_convs > 1 or _depth = 0")  # the root stays, so that every parent is there
    own = shared.withColumn("_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("_alone"))).withColumn("_saved", (F.col("n_convs") - 1) * F.col("_len"))
    whole = nodes.join(rolled_up(own), "_key", "left")
    ids = nodes.filter("n_children > 0").select(F.col("_key").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.filter("_depth = 0").select(F.col("_key").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = whole.filter("_depth > 1").join(ids, "_parent")
    high = whole.filter("_depth <= 1").join(F.broadcast(top), "_parent", "left")  # one row, for as many children as the root may have
    return deep.unionByName(high).select(
        "conv_id", F.col("_depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("_saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    rows = staged(numbered(turns, conv_col, turn_col, role_col, text_col), "numbered")
    return trie(paths(rows, rows.groupBy("_c").agg(F.max("_p").alias("_total"))))


def rebuilt_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations with shared heads, see ``rebuilt``."""
    rows, convs = rebuilt(staged(numbered(turns, conv_col, turn_col, role_col, text_col), "numbered"))
    return trie(paths(rows, convs))
