"""Links and connected groups over distributed tables; nothing is collected but an answer a round."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, only, staged


def _stars(links: DataFrame) -> bool:
    """Whether each node has one link down and none that leads to a node with a link down itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest reachable node as component, for every node that has an edge.

    Alternates large-star and small-star (Kiveris et al., 2014) until only stars are left: each round is two
    aggregations with map-side combination and joins on node ids, so a hub with many links is pre-aggregated and its
    join can be split. Each round is a written table, which replaces the one before. An edge from a node to itself
    counts as no edge; an empty table gives none.
    """
    links = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, links = links, staged(small, "links")
        discard(before)
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = staged(leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "groups")
    discard(links)
    return out


def bucket_components(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    across: Callable[[DataFrame], DataFrame],
    name: str,
    shared: DataFrame | None = None,
    ready: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Groups of the ids that share a bucket and pass verification, without forming all pairs of a bucket:
    (node, component) of the linked ids.

    buckets: (key, id, info), where an id has one info and may repeat in a bucket. Whether a key has two ids is told by
    four bits of 32, one of each byte, set by a hash of key and id, so that a pair alone in a bucket is overlooked there
    once in 4096 times. shared: the keys of two ids, where they are known already. ready: is told the ids (id) that the
    questions can be about, before the first.
    verify: takes distinct pairs (a, b, ia, ib), the infos as ia and ib, and returns the linked ones (a, b).

    A bucket's hub is its smallest id. First each id is tried against the hub that it shares most buckets with, then
    against its other hubs where that left them apart. After that the hubs are done with; of a hub's members only pairs
    across groups are open, so that a bucket whose members have met (a large group of copies) costs no pair. Of a hub with
    up to FEW open members the pairs across groups are verified. across: takes the open members (hub, id, c: group, info,
    hubs: all that the id is a member of) of the others, and returns (a, b) that connect all that is linked across groups of a hub.
    """
    shared = staged(_shared(buckets) if shared is None else shared, f"{name}-shared")
    crowded = staged(only(buckets, shared, "key").join(shared, "key", "left_semi"), f"{name}-crowded")
    discard(shared)
    hubs = crowded.groupBy("key").agg(F.min(F.struct("id", "info")).alias("hub"))
    star = crowded.join(hubs, "key").where("id <> hub.id")
    star = star.groupBy(F.col("hub.id").alias("a"), F.col("id").alias("b")).agg(F.min("hub.info").alias("ia"), F.min("info").alias("ib"), F.count("*").alias("n"))
    star = staged(star, f"{name}-star")
    discard(crowded)
    if ready:
        ready(star.select(F.col("a").alias("id")).union(star.select("b")).distinct())
    best = star.groupBy("b").agg(F.max_by(F.struct("a", "ia", "ib"), F.struct("n", -F.col("a"))).alias("x"))
    links = staged(verify(best.select("x.a", "b", "x.ia", "x.ib")), f"{name}-links")
    groups = connected_components(links)
    apart = _across(star, groups)
    more = staged(verify(apart), f"{name}-links")
    discard(links)
    groups = _merged(groups, more)
    of = groups.select(F.col("node").alias("id"), F.col("component").alias("c"))
    met = star.select(F.col("a").alias("hub"), F.col("b").alias("id"), F.col("ib").alias("info")).join(of, "id", "left")
    met = met.withColumn("c", F.coalesce("c", "id"))
    split = met.groupBy("hub").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("hub", "n")
    open_ = staged(met.join(split, "hub").select("hub", "id", "c", "info", "n"), f"{name}-open")
    few, many = open_.where(F.col("n") <= FEW), open_.where(F.col("n") > FEW).drop("n")
    x = few.select("hub", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("info").alias("ia"))
    y = few.select("hub", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("info").alias("ib"))
    pairs = x.join(y, "hub").where("a < b and ca <> cb").select("a", "b", "ia", "ib").distinct()
    found = staged(verify(pairs), f"{name}-few")
    groups = _merged(groups, found)
    if not many.isEmpty():
        many = many.join(many.groupBy("id").agg(F.collect_set("hub").alias("hubs")), "id")
        found = staged(across(many), f"{name}-many")
        groups = _merged(groups, found)
    discard(star, open_)
    return groups


def _shared(buckets: DataFrame) -> DataFrame:
    marked = buckets.select("key", F.xxhash64("key", "id").alias("mark"))
    one = " | ".join(f"shiftleft(1L, {8 * i} + cast(pmod(shiftright(mark, {16 * i}), 8) as int))" for i in range(4))
    marks = marked.select("key", F.expr(one).alias("mark")).groupBy("key").agg(F.bit_or("mark").alias("marks"))
    return marks.where("bit_count(marks) > 4").select("key")


#: Open members of a hub up to which their pairs are formed by a join.
FEW = 32


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b, ia, ib) whose ends are in different groups."""
    of = lambda k: groups.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return met.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "ia", "ib")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups with further links (a, b), staged; both are deleted. A group goes into it as one node, its smallest, so
    that the rounds work on the further links alone."""
    out = groups
    if not links.isEmpty():
        of = lambda k: groups.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        joined = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        to = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        moved = groups.join(to, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        out = staged(moved.unionByName(joined.join(groups, "node", "left_anti").select("node", "component")), "groups")
        discard(groups, joined)
    discard(links)
    return out


def tiles(members: DataFrame, size: Column, most: int, rows: int) -> DataFrame:
    """members (hub, id, ...) of each hub in tiles of a bounded total size and count, repeated for each other tile of the
    hub: rows of equal (hub, p, q) hold the tiles p and q, so that each two members of a hub meet in one task of bounded
    size."""
    n = members.groupBy("hub").agg(F.ceil(F.greatest(F.sum(size) / most, F.count("*") / rows, F.lit(1))).cast("int").alias("_t"))
    out = members.join(n, "hub").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("_t")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    return out.withColumn("p", F.least("tile", "_o")).withColumn("q", F.greatest("tile", "_o")).drop("_t", "_o")


def sides(tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the two tiles of a task; the same twice if there is one tile."""
    low, high = tile.min(), tile.max()
    x = np.flatnonzero(tile == low)
    return (x, x) if low == high else (x, np.flatnonzero(tile == high))


#: Candidates of the first batch that `spanning` asks; each next one has four times as many, up to MOST_ASKED.
FIRST_ASKED, MOST_ASKED = 256, 16384


def spanning(groups: np.ndarray, a: np.ndarray, b: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Of the candidates (a, b) among members of some groups those that are linked and connect what was apart, as rows.
    They are asked in turn, in growing batches; those that an earlier batch has connected, and those of one group, are not."""
    names, own = np.unique(groups, return_inverse=True)
    root, out, done, step = list(range(len(names))), [], 0, FIRST_ASKED

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while done < len(a):
        now = np.array([find(k) for k in range(len(names))])[own]
        x, y = a[done : done + step], b[done : done + step]
        apart = now[x] != now[y]
        x, y = x[apart], y[apart]
        hit = linked(x, y)
        for i, j in zip(x[hit].tolist(), y[hit].tolist()):
            s, t = find(own[i]), find(own[j])
            if s != t:
                root[max(s, t)] = min(s, t)
                out.append((i, j))
        done, step = done + step, min(4 * step, MOST_ASKED)
    return np.array(out, np.int64).reshape(-1, 2)
