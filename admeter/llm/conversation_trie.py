"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns. Its 128-bit key is the XOR of one hash per turn and
depth, so a prefix's key needs no sequence in memory and a parent's key is the child's key without
the last turn. Node (key) and path (conversation, depth) -> key are flat tables.

The rollup takes components of the forest apart. A node weighs its members, so a subtree's weight is
known without recursion: the turns that its members still have below it. Each round cuts every large
component at its centroid, the deepest node whose subtree holds half the weight: the centroid gets
the total of its subtree, so do the nodes on its path up to the component's top, and what hangs below
it and what is left above become components of at most half the weight. Components of at most
``TASK_WEIGHT`` are taken apart in the same way inside one task each.

Defined cases: rows without conv_id belong to no conversation; null role or text is empty; rows of
equal turn are ordered by role and text, repeated rows count each; an empty table has no nodes. Turns
of one conversation are numbered in ranges of 1024 turn numbers, so a conversation may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admeter.llm.common import partitions, scratch, table, text_or_empty
from admeter.llm.tiles import runs
from admeter.sources.shared import keep

#: A component of at most this weight (at least its number of nodes) is finished in one task.
TASK_WEIGHT = 1 << 16
#: Small tables of the rounds are broadcast up to this many rows.
BROADCAST_ROWS = 10_000
#: Turn numbers, and depths, of one range within a conversation (as a power of two).
RANGE_BITS = 10
#: conv_ids of one piece of a node's list (as a power of two).
PIECE_BITS = 16
#: Conversations of a family share up to 8 first turns.
FAMILY, HEAD = 5, 8

#: Rows of a frame that leaves a task.
FRAME = 20_000

Keep = Callable[[DataFrame, str], DataFrame]
KEY = ["k1", "k2"]
STATE = (
    "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, n_children long, bytes long, "
    "leaf long, saved long, n_leaves long, saved_tokens long, weight long, t1 long, t2 long, top_depth long, total long"
)


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first), h1, h2, bytes of every turn."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long").alias("turn"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
    )
    reach = F.shiftright(F.col("turn"), RANGE_BITS).alias("reach")
    rows = rows.withColumn("reach", reach)
    own = Window.partitionBy("conv_id", "reach").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(own)).select(
        "conv_id",
        "reach",
        "pos",
        F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "text", "role").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    counts = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long"), reach).count()
    before = Window.partitionBy("conv_id").orderBy("reach").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.sum("count").over(before)).where("before is not null")
    same = (F.col("conv_id") == F.col("c")) & F.col("reach").eqNullSafe(F.col("r"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("reach").alias("r"), "before")
    rows = rows.join(counts, same, "left")
    return rows.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "bytes")


def rebuilt(turns: DataFrame, keep: Keep) -> DataFrame:
    """conv_id, depth, h1, h2, bytes, length: the turns of every rebuilt conversation.

    Depth 0 is a row without turn for each of them; length is its number of turns.
    """
    rows = keep(numbered(turns), "trie-turns")
    heads = rows.where(F.col("pos") <= HEAD).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "bytes"))).alias("head")
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), "n", h.alias("h")
    )
    convs = convs.join(heads.select(F.col("conv_id").alias("base"), "head"), "base", "left")
    shared = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("head", shared).select(
        "conv_id",
        "h",
        "head",
        (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
    )
    convs = keep(convs, "trie-conversations")
    root = F.array(F.struct(F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(x) for x in ("h1", "h2", "bytes")]))
    first = convs.select("conv_id", "length", F.explode(F.concat(root, "head")).alias("x"))
    first = first.select("conv_id", F.col("x.pos").cast("long").alias("depth"), "x.h1", "x.h2", "x.bytes", "length")
    own = rows.join(convs.select("conv_id", "h", F.size("head").alias("m"), "length"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") + F.col("m") - F.col("h")).alias("depth"), "h1", "h2", "bytes", "length")
    return first.unionByName(own)


def paths(turns: DataFrame, keep: Keep) -> DataFrame:
    """conv_id, depth, key (k1, k2) and parent key (p1, p2) of the node there, bytes, length."""
    rows = rebuilt(turns, keep).withColumn("reach", F.shiftright("depth", RANGE_BITS))
    # the root's row has no turn and changes no key
    x = [F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(f"h{i}", "depth", f"h{3 - i}")) for i in (1, 2)]
    rows = rows.select("conv_id", "depth", "reach", "bytes", "length", x[0].alias("x1"), x[1].alias("x2"))
    sums = rows.where(F.col("length") >= 1 << RANGE_BITS).groupBy("conv_id", "reach").agg(
        F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2")
    )
    before = Window.partitionBy("conv_id").orderBy("reach").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "reach", *[F.bit_xor(b).over(before).alias(b) for b in ("b1", "b2")])
    rows = rows.join(sums, ["conv_id", "reach"], "left")
    upto = Window.partitionBy("conv_id", "reach").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.bit_xor(f"x{i}").over(upto).bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)]
    rows = rows.withColumns({"k1": keys[0], "k2": keys[1]})
    parent = [F.when(F.col("depth") > 0, F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}"))).alias(f"p{i}") for i in (1, 2)]
    return rows.select("conv_id", "depth", "k1", "k2", *parent, "bytes", "length")


def nodes(path: DataFrame, keep: Keep) -> DataFrame:
    """One row per node in the columns of ``STATE``: one component, nothing rolled up yet."""
    found = path.groupBy(*KEY).agg(
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("bytes").alias("bytes"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    found = keep(found, "trie-nodes")
    kids = found.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    found = found.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    top = found.where("depth = 0").agg(F.max("weight")).first()[0] or 0
    extra = {
        "leaf": (F.col("n_children") == 0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("bytes"),
        "t1": F.lit(0),
        "t2": F.lit(0),
        "top_depth": F.lit(0),
        "total": F.lit(top),
        "n_leaves": F.lit(0),
        "saved_tokens": F.lit(0),
    }
    return typed(found.withColumns(extra))


def typed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STATE.split(", ")])


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def equal(*pairs: tuple[str, str]) -> Column:
    on = F.lit(True)
    for a, b in pairs:
        on = on & (F.col(a) == F.col(b))
    return on


def cut(state: DataFrame, path: DataFrame, limit: int, keep: Keep) -> DataFrame:
    """One round: every component of ``state`` is cut at its centroid; a centroid has total 0 then."""
    best = F.min_by(F.struct("k1", "k2", "depth", "conv_id", "weight"), "weight")
    chosen = state.where(2 * F.col("weight") >= F.col("total")).groupBy("t1", "t2", "top_depth").agg(best.alias("c"))
    chosen = chosen.select(
        "t1", "t2", F.col("top_depth").alias("ct"), F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"),
        F.col("c.depth").alias("cd"), F.col("c.conv_id").alias("cc"), F.col("c.weight").alias("cw"),
    )
    chosen = keep(chosen, "trie-centroids")
    n = chosen.count()
    rows = state.join(small(chosen, n), ["t1", "t2"])

    # below the centroid: the ancestor one step below it names the new component
    at = path.select(
        F.col("conv_id").alias("conv"), F.col("depth").alias("at"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
        F.col("p1").alias("q1"), F.col("p2").alias("q2"),
    )
    deep = rows.where("depth > cd").join(at, (F.col("conv_id") == F.col("conv")) & (F.col("at") == F.col("cd") + 1))
    deep = deep.withColumn("inside", equal(("q1", "c1"), ("q2", "c2"))).drop("conv", "at", "q1", "q2")
    rest = rows.where("depth <= cd").withColumns({"u1": F.lit(None).cast("long"), "u2": F.lit(None).cast("long"), "inside": F.lit(False)})
    here = equal(("k1", "c1"), ("k2", "c2"), ("depth", "cd"))
    marked = keep(deep.unionByName(rest).withColumn("here", here), "trie-marked")

    # what the path from the centroid to its top gets
    mine = marked.where("inside or here").groupBy("c1", "c2").agg(F.sum("leaf").alias("add_leaves"), F.sum("saved").alias("add_saved"))
    mine = keep(mine, "trie-totals")
    up = small(chosen, n).join(mine, ["c1", "c2"])
    up = path.select("conv_id", "depth", *KEY).join(
        small(up, n), (F.col("conv_id") == F.col("cc")) & (F.col("depth") <= F.col("cd")) & (F.col("depth") >= F.col("ct"))
    ).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("cw").alias("less"), "add_leaves", "add_saved")
    above = marked.where("not inside").join(up, equal(("k1", "a1"), ("k2", "a2")), "left")
    less = F.coalesce("less", F.lit(0))
    above = above.withColumns(
        {
            "n_leaves": F.col("n_leaves") + F.coalesce("add_leaves", F.lit(0)),
            "saved_tokens": F.col("saved_tokens") + F.coalesce("add_saved", F.lit(0)),
            "weight": F.when(F.col("here"), F.col("weight")).otherwise(F.col("weight") - less),
            "total": F.when(F.col("here"), 0).otherwise(F.col("total") - F.col("cw")),
        }
    )

    # only the weights of large new components matter; there are at most total / limit of them
    large = marked.where(F.col("inside") & equal(("p1", "c1"), ("p2", "c2")) & (F.col("weight") > limit))
    large = keep(large.select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("weight").alias("lw")), "trie-parts")
    below = marked.where("inside").join(small(large, large.count()), equal(("u1", "l1"), ("u2", "l2")), "left")
    below = below.withColumns(
        {"t1": F.col("u1"), "t2": F.col("u2"), "top_depth": F.col("cd") + 1, "total": F.coalesce("lw", F.lit(1))}
    )
    return typed(above).unionByName(typed(below))


def split(order: np.ndarray, parent: np.ndarray, weight: np.ndarray, values: np.ndarray, sums: np.ndarray) -> None:
    """Rolls one component up: ``order`` holds its nodes by depth, ``sums`` gets their subtrees' values."""
    todo = [order]
    mark = np.full(len(parent), -1, np.int64)
    while todo:
        part = todo.pop()
        if len(part) == 1:
            sums[part[0]] += values[part[0]]
            continue
        w = weight[part]
        heavy = part[2 * w >= w[0]]
        c = heavy[np.argmin(weight[heavy])]
        mark[part] = -1
        below: dict[int, list[int]] = {}
        for v in part[np.searchsorted(part, c) + 1 :].tolist():  # nodes are numbered by depth
            p = parent[v]
            u = v if p == c else mark[p] if p >= 0 else -1
            if u >= 0:
                mark[v] = u
                below.setdefault(u, []).append(v)
        inside = np.concatenate([[c], *below.values()]).astype(np.int64)
        total = values[inside].sum(0)
        less, v = weight[c], c
        while True:
            sums[v] += total
            weight[v] -= less
            if v == part[0]:
                break
            v = parent[v]
        mark[c] = c
        above = part[mark[part] < 0]
        if len(above):
            todo.append(above)
        todo += [np.array(x, np.int64) for x in below.values()]


def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Takes whole components apart, sorted by top and depth."""
    out, n = [], 0
    for g in runs(batches, ["t1", "t2", "top_depth"]):
        index = {k: i for i, k in enumerate(zip(g["k1"].tolist(), g["k2"].tolist(), strict=True))}
        up = zip(g["p1"].tolist(), g["p2"].tolist(), strict=True)
        parent = np.fromiter((index.get(p, -1) for p in up), np.int64, len(index))
        parent[0] = -1
        sums = np.zeros((len(index), 2), np.int64)
        values = np.stack([g["leaf"], g["saved"]], 1)
        split(np.arange(len(index)), parent, g["weight"].copy(), values, sums)
        g["n_leaves"] = g["n_leaves"] + sums[:, 0]
        g["saved_tokens"] = g["saved_tokens"] + sums[:, 1]
        out.append(pd.DataFrame(g))
        n += len(index)
        if n >= FRAME:
            yield pd.concat(out)
            out, n = [], 0
    if out:
        yield pd.concat(out)


def rolled_up(state: DataFrame, path: DataFrame, keep: Keep, limit: int = TASK_WEIGHT) -> DataFrame:
    """``state`` with the sums of ``leaf`` and ``saved`` over each node's subtree."""
    spark = state.sparkSession
    now = keep(state, "trie-round")
    done, rest = now.where("total = 0"), now.where((F.col("total") > 0) & (F.col("total") <= limit))
    while not (large := now.where(F.col("total") > limit)).isEmpty():
        with scratch(spark) as held:
            now = keep(cut(large, path, limit, held), "trie-round")
        done = done.unionByName(now.where("total = 0"))
        rest = rest.unionByName(now.where((F.col("total") > 0) & (F.col("total") <= limit)))
    rest = rest.fillna(0, ["p1", "p2"])  # only the root has no parent
    rest = rest.repartition(partitions(spark), "t1", "t2").sortWithinPartitions("t1", "t2", "top_depth", "depth", *KEY)
    return rest.mapInPandas(finish, STATE).unionByName(done)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, digest = None, None
    for pdf in batches:
        out = []
        for k1, k2, ids in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["ids"].tolist(), strict=True):
            if held == (k1, k2):
                digest.update(b"," + ids.encode())
                continue
            if held:
                out.append((*held, digest.hexdigest()))
            held, digest = (k1, k2), hashlib.sha256(ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
    if held:
        yield pd.DataFrame([(*held, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def ends(path: DataFrame, keep: Keep) -> DataFrame:
    """Key and digest of the conv_ids that end at a node, of nodes where any does.

    A list is joined in pieces of ``1 << PIECE_BITS`` possible conv_ids; lists of several pieces are
    hashed piece by piece in ascending order.
    """
    rows = path.where(F.col("depth") == F.col("length"))
    piece = F.shiftright("conv_id", PIECE_BITS).alias("piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = keep(rows.groupBy(*KEY, piece).agg(text.alias("ids")), "trie-ends")
    many = pieces.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    one = many.where("n = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = pieces.join(many.where("n > 1").select(*KEY), KEY, "left_semi")
    several = several.repartition(partitions(path.sparkSession), *KEY).sortWithinPartitions(*KEY, "piece")
    return one.unionByName(several.select(*KEY, "ids").mapInPandas(_digests, "k1 long, k2 long, ends_sha256 string"))


def trie(turns: DataFrame, limit: int = TASK_WEIGHT) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations of ``turns``."""
    with scratch(turns.sparkSession) as held:
        path = held(paths(turns, held), "trie-paths")
        found = rolled_up(nodes(path, held), path, held, limit)
        found = found.select(*KEY, "p1", "p2", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        found = held(found, "trie-rolled")
        none = F.lit(hashlib.sha256(b"").hexdigest())
        found = found.join(ends(path, held), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
        up = found.where("n_children > 0").select(
            F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("ud")
        )
        same = equal(("p1", "u1"), ("p2", "u2")) & (F.col("depth") == F.col("ud") + 1)
        found = found.join(up, same, "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
        )
        return keep(found, "trie")


def op13_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the trie over all conversations; see the module for nulls, ties and empty tables."""
    return trie(table(spark, sf, "conversations"))
