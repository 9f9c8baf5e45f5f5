"""Sharding by a k-d tree over text metadata.

Each document is a point whose coordinates depend on its text alone: size, share of multi-byte
characters, share of blanks, each completed by bits of a text hash so that only equal texts
coincide. A node of the tree is cut along its widest dimension at the weighted median (weight:
bytes), found by histograms that Spark sums and that are refined inside the bin of the median.
Texts whose copies together weigh more than a small part of a shard cannot be cut by a tree
that keeps copies together; these few groups are placed first, and the tree fills what is left.
The driver sees bounds of nodes and the heavy groups, whose number is bounded by the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admeter.llm.common import partitions, table, text_or_empty
from admeter.sources.shared import keep

SHARDS = 16
#: A group of copies above this part of a shard is heavy: at most ``shards * HEAVY_PART`` of them.
HEAVY_PART = 64
BINS = 4096
#: A cut may be off by this part of a shard before it is refined further.
TOLERANCE = 1 / 512
TIE_BITS = 31
DIMENSIONS = ("d_size", "d_wide", "d_blank")


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a hash of the text, and one sortable long per dimension."""
    t = text_or_empty()
    chars, octets = F.greatest(F.char_length(t), F.lit(1)), F.octet_length(t)
    blanks = F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit("")))
    tie = F.shiftrightunsigned(F.xxhash64(t), 64 - TIE_BITS)

    def axis(v: Column) -> Column:
        return F.shiftleft(v.cast("long"), TIE_BITS) + tie

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (octets + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("h"),
        axis(F.log2(octets + 1) * 2.0**16).alias("d_size"),
        axis((octets - F.char_length(t)) * 2.0**20 / chars).alias("d_wide"),
        axis(blanks * 2.0**20 / chars).alias("d_blank"),
    )


@dataclass
class Node:
    """A part of the tree: the shards ``first`` to ``last`` and, once cut, two parts."""

    first: int
    last: int
    dim: str = ""
    cut: int = 0
    below: Node | None = None
    above: Node | None = None

    def leaf(self) -> Column:
        """The first shard of the lowest node a point lies in; it names that node."""
        if self.below is None or self.above is None:
            return F.lit(self.first)
        return F.when(F.col(self.dim) <= self.cut, self.below.leaf()).otherwise(self.above.leaf())


def _lookup(values: dict[int, object], kind: str = "long") -> Column:
    out = F.lit(None).cast(kind)
    for node, v in values.items():
        out = F.when(F.col("node") == node, F.lit(v).cast(kind)).otherwise(out)
    return out


def _widest(at: DataFrame, scale: dict[str, int]) -> dict[int, dict]:
    """Of each node: weight, and the dimension that is widest against the whole table."""
    spans = [f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)]
    out = {}
    for r in at.groupBy("node").agg(F.sum("size").alias("w"), *spans).collect():
        wide = max(DIMENSIONS, key=lambda d: (r[f"{d}_max"] - r[f"{d}_min"]) / max(scale[d], 1))
        out[r["node"]] = {"w": r["w"], "dim": wide, "lo": r[f"{wide}_min"], "hi": r[f"{wide}_max"]}
    return out


def _weighted_cuts(at: DataFrame, spec: dict[int, dict], slack: float) -> dict[int, int]:
    """Per node the coordinate with about ``goal`` bytes at or below it."""
    cuts: dict[int, int] = {}
    state = {n: dict(s, base=0) for n, s in spec.items()}
    while state:
        width = {n: (s["hi"] - s["lo"]) // BINS + 1 for n, s in state.items()}
        dim = F.lit(None).cast("long")
        for n, s in state.items():
            dim = F.when(F.col("node") == n, F.col(s["dim"])).otherwise(dim)
        lo = _lookup({n: s["lo"] for n, s in state.items()})
        hi = _lookup({n: s["hi"] for n, s in state.items()})
        bins = (
            at.withColumn("p", dim)
            .where(F.col("p").between(lo, hi))
            .groupBy("node", F.floor((F.col("p") - lo) / _lookup(width)).alias("bin"))
            .agg(F.sum("size").alias("w"))
        )
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        goal = _lookup({n: s["goal"] - s["base"] for n, s in state.items()}, "double")
        reached = bins.withColumn("upto", upto).where(F.col("upto") >= goal)
        found = reached.groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("x")).collect()
        left = {r["node"]: r["x"] for r in found}
        for n in list(state):
            s, x = state[n], left.get(n)
            if x is None:  # rounding: everything lies below the goal
                cuts[n] = state.pop(n)["hi"]
                continue
            start = s["lo"] + x["bin"] * width[n]
            end = min(s["hi"], start + width[n] - 1)
            before, after = s["base"] + x["upto"] - x["w"], s["base"] + x["upto"]
            if start == end or x["w"] <= slack:
                nearer = s["goal"] - before < after - s["goal"]
                cuts[n] = start - 1 if nearer else end
                state.pop(n)
            else:
                s.update(lo=start, hi=end, base=before)
    return cuts


def _place_heavy(pts: DataFrame, total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each heavy text hash, largest first to the emptiest shard, and the loads."""
    heavy = (
        pts.groupBy("h").agg(F.sum("size").alias("w"))
        .where(F.col("w") > F.lit(total / (shards * HEAVY_PART)))
        .collect()
    )
    loads, placed = [0] * shards, {}
    for r in sorted(heavy, key=lambda r: (-r["w"], r["h"])):
        to = loads.index(min(loads))
        placed[r["h"]] = to
        loads[to] += r["w"]
    return placed, loads


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    Shards hold nearly equal bytes and equal texts share a shard; copies that together exceed a
    shard's share still stay together. Null text counts as empty (size 1). Rows may repeat; each
    gets a slot. An empty table gives an empty result. Other columns are not looked at.
    """
    pts = keep(points(docs), "kd-points")
    return number(pts.withColumn("shard", shard_column(pts, shards)))


def shard_column(pts: DataFrame, shards: int) -> Column:
    spans = [(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
    whole = pts.agg(F.sum("size").alias("w"), *spans).first()
    if not whole["w"]:
        return F.lit(0)
    total, scale = whole["w"], {d: whole[d] for d in DIMENSIONS}
    placed, loads = _place_heavy(pts, total, shards)
    room = [max(0.0, total / shards - x) for x in loads]
    heavy = F.lit(None).cast("int")
    if placed:
        pairs = [F.lit(x) for h, s in placed.items() for x in (h, s)]
        heavy = F.try_element_at(F.create_map(*pairs), F.col("h"))
    light = pts.where(heavy.isNull())
    root = Node(0, shards - 1)
    open_nodes = [root]
    while open_nodes:
        at = light.withColumn("node", root.leaf())
        spec = _widest(at, scale)
        for n in open_nodes:
            middle = (n.first + n.last) // 2
            if n.first in spec:
                mine = sum(room[n.first : n.last + 1])
                share = sum(room[n.first : middle + 1]) / mine if mine else 0.5
                spec[n.first]["goal"] = spec[n.first]["w"] * share
        spec = {k: v for k, v in spec.items() if "goal" in v}
        cuts = _weighted_cuts(at, spec, TOLERANCE * total / shards)
        nxt = []
        for n in open_nodes:
            if n.first not in cuts:
                continue
            middle = (n.first + n.last) // 2
            n.dim, n.cut = spec[n.first]["dim"], cuts[n.first]
            n.below, n.above = Node(n.first, middle), Node(middle + 1, n.last)
            nxt += [x for x in (n.below, n.above) if x.first < x.last]
        open_nodes = nxt
    return F.coalesce(heavy, root.leaf())


def number(rows: DataFrame) -> DataFrame:
    """Gapless slots from 0 per shard: row numbers in hash buckets, plus what lies before them."""
    n = partitions(rows.sparkSession)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(n)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h")
    # at most shards * shuffle partitions rows
    return (
        rows.withColumn("rn", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("rn")).cast("long").alias("slot"),
        )
    )


def op3_kd_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard(table(spark, sf, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
