"""K-d tree partitioning of a table into shards of near-equal bytes, and the query op4.

Rows with equal texts form a group that stays in one shard. A node of the tree takes a number of shards; it is split
along the metadata dimension in which its groups are the widest, at the weighted median (in general the quantile
that leaves either side the bytes of a whole number of shards). Medians are found by counting: one aggregation of
bytes by node and bin, refined in the bin that holds the cut, for all nodes of a level at once; the driver sees a
bounded number of bins, never a row. Places within a shard are numbered in hashed blocks with a table of offsets.

Defined cases: a null text is the empty text; null metadata are a value of their own; rows that repeat a doc_id are
rows like any other; an empty table gives no rows; with fewer groups than shards some shards stay empty; a group
larger than a shard has one to itself, and the others share the rest evenly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import documents, staged

SHARDS, BINS, BLOCKS = 24, 1024, 256
#: A cut is near enough at this share of a shard's bytes.
NEAR = 0.001
#: A coordinate: 20 bits of the metadata, then 32 bits of the group's hash, so that equal values can be split.
TOP, LOW = 20, 32


@dataclass
class Node:
    """shards: how many it stands for; a leaf has one. Groups with dims[dim] < cut go left."""

    shards: int
    number: int
    dim: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def route(node: Node) -> Column:
    """The number of a group's leaf node."""
    if node.dim is None:
        return F.lit(node.number)
    return F.when(F.col(node.dim) < F.lit(node.cut), route(node.left)).otherwise(route(node.right))


def leaves(node: Node) -> list[Node]:
    return [node] if node.dim is None else leaves(node.left) + leaves(node.right)


def split_all(groups: DataFrame, open_: list[Node], root: Node, dims: list[str]) -> None:
    """Split every open node: the widest dimension, then its quantile by refined histograms."""
    spans = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    at = groups.withColumn("node", route(root)).where(F.col("node").isin([n.number for n in open_]))
    seen = {r["node"]: r for r in at.groupBy("node").agg(F.sum("bytes").alias("w"), F.count("*").alias("n"), *spans).collect()}
    state = {}
    for node in open_:
        if (r := seen.get(node.number)) is None:
            continue
        wide = max(dims, key=lambda d: ((r[f"hi_{d}"] >> LOW) - (r[f"lo_{d}"] >> LOW), r[f"hi_{d}"] - r[f"lo_{d}"]))
        state[node.number] = {"dim": wide, "lo": r[f"lo_{wide}"], "hi": r[f"hi_{wide}"] + 1, "below": 0, "w": r["w"], "node": node}
    cuts: dict[int, tuple[float, int, int]] = {}
    left = dict(state)
    while left:
        lo, width, dim = F.lit(0), F.lit(1), F.lit(0)
        keep = F.lit(False)
        for number, s in left.items():
            step = -(-(s["hi"] - s["lo"]) // BINS)
            s["step"] = step
            here = F.col("node") == number
            dim = F.when(here, F.col(s["dim"])).otherwise(dim)
            lo, width = F.when(here, F.lit(s["lo"])).otherwise(lo), F.when(here, F.lit(step)).otherwise(width)
            keep = keep | (here & (F.col(s["dim"]) >= s["lo"]) & (F.col(s["dim"]) < s["hi"]))
        bins = at.where(keep).groupBy("node", F.floor((dim - lo) / width).cast("long").alias("bin")).agg(F.sum("bytes").alias("b"))
        found: dict[int, list] = {}
        for r in bins.collect():  # BINS rows a node at most
            found.setdefault(r["node"], []).append((r["bin"], r["b"]))
        done = []
        for number, s in left.items():
            k, target = s["node"].shards, s["w"] / s["node"].shards
            want, below, nxt = target * (k // 2), s["below"], None
            for b, w in sorted(found.get(number, [])):
                for edge, sum_ in ((b, below), (b + 1, below + w)):
                    shards = min(k - 1, max(1, round(sum_ / target)))
                    off = abs(sum_ - shards * target) / target
                    cut = (off + (abs(sum_ - want) > target), s["lo"] + edge * s["step"], shards)
                    if 0 < sum_ < s["w"] and (number not in cuts or cut < cuts[number]):
                        cuts[number] = cut
                if below <= want < below + w:
                    nxt = (s["lo"] + b * s["step"], below)
                below += w
            if (number in cuts and cuts[number][0] < NEAR) or s["step"] == 1 or nxt is None:
                done.append(number)
            else:
                s["lo"], s["hi"], s["below"] = nxt[0], nxt[0] + s["step"], nxt[1]
        for number in done:
            left.pop(number)
    for number, s in state.items():
        if number in cuts:
            node, (_, cut, shards) = s["node"], cuts[number]
            node.dim, node.cut = s["dim"], cut
            node.left, node.right = Node(shards, 2 * number + 1), Node(node.shards - shards, 2 * number + 2)


def kd_tree(groups: DataFrame, dims: list[str], shards: int) -> Node:
    root = Node(shards, 0)
    tried: set[int] = set()
    while open_ := [n for n in leaves(root) if n.shards > 1 and n.number not in tried]:
        tried |= {n.number for n in open_}
        split_all(groups, open_, root, dims)
    return root


def larger_than_a_shard(groups: DataFrame, shards: int) -> list[int]:
    """Hashes of the groups that fill a shard of their own, fewer than shards: each is above the mean of what is left."""
    found: list[int] = []
    while True:
        rest = groups.where(~F.col("group").isin(found)) if found else groups
        total = rest.agg(F.sum("bytes")).first()[0] or 0
        big = rest.where(F.col("bytes") * (shards - len(found)) > total).select("group").distinct().collect() if len(found) < shards - 1 else []
        if not big:
            return found
        found += [r[0] for r in big]


def coordinate(value: Column) -> Column:
    """20 bits of metadata above 32 bits of the group's hash."""
    return F.shiftleft(value.cast("long"), LOW) + F.col("tie")


def shard(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None, meta: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; with target_bytes as many shards as the bytes need."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        *[F.shiftrightunsigned(F.xxhash64(F.col(m).cast("string"), F.col(m).isNull()), 64 - TOP).alias(f"of_{m}") for m in meta],
    )
    rows = staged(rows, "op4-rows")
    key = ["group", "text_crc32", "size"]
    groups = rows.groupBy(key).agg(F.sum("size").alias("bytes"), *[F.min(f"of_{m}").alias(f"of_{m}") for m in meta])
    if target_bytes:
        shards = max(1, -(-(groups.agg(F.sum("bytes")).first()[0] or 0) // target_bytes))
    groups = groups.withColumn("tie", F.shiftrightunsigned(F.xxhash64(*key), LOW))
    scale = (1 << TOP) / 44.0  # e**44 bytes are beyond any text
    dims = {f"d_{m}": coordinate(F.col(f"of_{m}")) for m in meta} | {"d_size": coordinate(F.floor(F.log(F.col("size").cast("double")) * scale))}
    groups = staged(groups.select(*key, "bytes", *[c.alias(d) for d, c in dims.items()]), "op4-groups")
    alone = larger_than_a_shard(groups, shards)
    root = kd_tree(groups.where(~F.col("group").isin(alone)) if alone else groups, list(dims), shards - len(alone))
    number = {n.number: i for i, n in enumerate(leaves(root), len(alone))}
    named = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    place = named[route(root)]
    for i, group in enumerate(alone):
        place = F.when(F.col("group") == group, F.lit(i)).otherwise(place)
    placed = groups.select(*key, place.alias("shard"))
    out = rows.select("doc_id", *key).join(placed, key).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int"))
    out = staged(out, "op4-placed")
    counts = out.groupBy("shard", "block").agg(F.count("*").alias("n"))  # shards * BLOCKS rows at most
    before = F.sum("n").over(_by("shard", "block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(_by(["shard", "block"], ["doc_id", "text_crc32"])).cast("long") - 1
    out = out.withColumn("nth", nth).join(F.broadcast(counts), ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("nth") + F.col("before")).alias("slot"))


def _by(partition, order) -> WindowSpec:
    return Window.partitionBy(partition).orderBy(order)


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
