"""Typed person graph: sampled edges, neighbour means and return probabilities."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.ids import draw
from ..session import cut, ship_package
from . import spatial
from .groups import group_positions

# Start nodes whose walks one Python call follows; it holds the cluster's edges and
# a column per start node.
WALK_BLOCK = 2048
# Edges of small clusters in one task of the walks by joins.
WALK_EDGES = 50_000


def _undirected(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def sample_group_peers(nodes: DataFrame, group: str, n_peers: int | Column, node: str = "node",
                       exclude: str | None = None, seed: int = 0) -> DataFrame:
    """Pairs (u < v) of a node and n peers drawn with replacement from its group.

    A draw is a hash of (seed, node, draw) taken modulo the group size, and the
    peer is found by its position: the join key (group, position) is unique, so
    a huge group costs no more per row than a small one. Draws of the node
    itself, and of peers that agree on ``exclude``, are dropped.
    """
    cols = [group, node] + ([exclude] if exclude else [])
    placed = group_positions(nodes.select(*cols).filter(F.col(group).isNotNull()), [group], node,
                             seed, pos="pos", size="size").filter(F.col("size") >= 2)
    n = n_peers if isinstance(n_peers, Column) else F.lit(n_peers)
    draws = placed.withColumn("draw", F.explode(F.sequence(F.lit(1), n.cast("int")))).withColumn(
        "target", draw(F.lit(seed + 1), F.col(node), F.col("draw")) % F.col("size"))
    peers = placed.select(F.col(group), F.col("pos").alias("target"), F.col(node).alias("peer"),
                          *([F.col(exclude).alias("peer_x")] if exclude else []))
    hit = draws.join(peers, [group, "target"]).filter(F.col(node) != F.col("peer"))
    if exclude:
        hit = hit.filter(F.col(exclude) != F.col("peer_x"))
    return hit.select(*_undirected(F.col(node), F.col("peer"))).distinct()


def household_edges(people: DataFrame, node: str = "person_row", household: str = "household_row",
                    limit: int = C.HOUSEHOLD_CLIQUE_LIMIT, peers: int = C.SAME_ADDRESS_PEERS,
                    seed: int = 0) -> DataFrame:
    """All pairs in households of at most ``limit`` people, sampled peers in larger ones."""
    p = people.select(F.col(node).alias("node"), F.col(household).alias("hh"))
    sizes = p.groupBy("hh").agg(F.count(F.lit(1)).alias("n"))
    sized = p.join(sizes, "hh")
    small = sized.filter(F.col("n").between(2, limit)).select("hh", "node")
    pairs = (small.join(small.withColumnRenamed("node", "other"), "hh")
             .filter(F.col("node") < F.col("other"))
             .select(F.col("node").alias("u"), F.col("other").alias("v")))
    return pairs.unionByName(sample_group_peers(
        sized.filter(F.col("n") > limit), "hh", peers, seed=seed))


def same_address_groups(people: DataFrame, node: str = "person_row",
                        household: str = "household_row") -> DataFrame:
    """Nodes at an address that holds more than one household."""
    addr = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                              for c in ("county", "city", "street_name", "address_number")])
    p = people.select(F.col(node).alias("node"), F.col(household).alias("hh"), addr.alias("addr"))
    shared = p.groupBy("addr").agg(F.min("hh").alias("a"), F.max("hh").alias("b")).filter(
        F.col("a") != F.col("b")).select("addr")
    return p.join(shared, "addr")


def same_address_edges(people: DataFrame, seed: int = 0, **names) -> DataFrame:
    return sample_group_peers(same_address_groups(people, **names), "addr", C.SAME_ADDRESS_PEERS,
                              exclude="hh", seed=seed)


def ed_edges(people: DataFrame, node: str = "person_row", ed: str = "ed_key",
             seed: int = 0) -> DataFrame:
    return sample_group_peers(people.select(F.col(node).alias("node"), F.col(ed).alias("ed")),
                              "ed", C.ED_PEERS, seed=seed)


def spatial_edges(people: DataFrame, k: int = C.KNN_K, node: str = "person_row",
                  seed: int = 0) -> DataFrame:
    """Each person with one hash-chosen member of each of the k nearest other points.
    A point goes by the smallest node on it."""
    geo = people.select(F.col(node).alias("node"), "lon", "lat").dropna()
    named = geo.groupBy("lon", "lat").agg(F.min("node").alias("point"))
    near = spatial.nearest_points(spatial.metric_points(geo).join(named, ["lon", "lat"]), "point", k).select("point", "neighbor")
    members = cut(group_positions(geo.join(named, ["lon", "lat"]).select("node", "point"), ["point"], "node", seed))
    sizes = members.groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    asks = (members.select("node", "point").join(near, "point")
            .join(sizes.withColumnRenamed("point", "neighbor"), "neighbor")
            .withColumn("pos", draw(F.lit(seed + 1), F.col("node"), F.col("neighbor")) % F.col("n")))
    partner = members.select(F.col("point").alias("neighbor"), "pos", F.col("node").alias("peer"))
    return (asks.join(partner, ["neighbor", "pos"])
            .select(*_undirected(F.col("node"), F.col("peer"))).distinct())


def codonor_members(donors: DataFrame, node: str = "person_row",
                    low: int = C.COMMITTEE_MIN_DONORS,
                    high: int = C.COMMITTEE_MAX_DONORS) -> DataFrame:
    """Distinct (person, committee) of committees with low..high donors, conduits left out."""
    d = donors.select(F.col(node).alias("node"), "committee").filter(
        ~F.upper("committee").isin(C.DEM_CONDUITS + C.REP_CONDUITS)).distinct()
    ok = d.groupBy("committee").agg(F.count(F.lit(1)).alias("donors")).filter(
        F.col("donors").between(low, high))
    return d.join(ok, "committee")


def codonor_edges(donors: DataFrame, node: str = "person_row", peers: int = C.CODONOR_PEERS,
                  seed: int = 0) -> DataFrame:
    draws = F.least(F.lit(peers), F.col("size") - 1)
    return sample_group_peers(codonor_members(donors, node), "committee", draws, seed=seed)


def combine_edges(parts: dict[str, DataFrame]) -> DataFrame:
    """One typed edge per undirected pair; the type of highest priority is kept."""
    union = None
    for etype, df in parts.items():
        typed = df.select("u", "v", F.lit(C.EDGE_PRIORITY[etype]).alias("p"),
                          F.lit(etype).alias("etype"))
        union = typed if union is None else union.unionByName(typed)
    return union.groupBy("u", "v").agg(F.min_by("etype", "p").alias("etype"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge once per direction (exploded from one read, not a second scan)."""
    pair = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")),
                   F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(F.explode(pair).alias("e"), *rest).select("e.u", "e.v", *rest)


def build_edges(people: DataFrame, donors: DataFrame, seed: int = 0) -> DataFrame:
    return combine_edges({
        "household": household_edges(people, seed=seed),
        "same_address": same_address_edges(people, seed=seed + 10),
        "ed": ed_edges(people, seed=seed + 20),
        "spatial_knn": spatial_edges(people, seed=seed + 30),
        "donation": codonor_edges(donors, seed=seed + 40)})


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("etype").agg(F.count(F.lit(1)).alias("edges"))


def intra_cluster_edges(edges: DataFrame, clusters: DataFrame, node: str = "person_row") -> DataFrame:
    """Directed edges whose ends share a cluster, with that cluster."""
    c = clusters.select(F.col(node).alias("node"), "cluster")
    e = edges.join(c.withColumnsRenamed({"node": "u", "cluster": "cu"}), "u")
    e = e.join(c.withColumnsRenamed({"node": "v", "cluster": "cv"}), "v")
    return e.filter(F.col("cu") == F.col("cv")).withColumnRenamed("cu", "cluster").drop("cv")


def neighbor_means(directed: DataFrame, features: DataFrame, columns: list[str], hops: int = 1,
                   node: str = "person_row") -> DataFrame:
    """Mean of the neighbours' features per edge type, repeated ``hops`` times.

    Hop h averages the neighbours' hop h-1 values along the same edge type.
    """
    values = features.select(F.col(node).alias("v"), *columns)
    on, out = ["v"], None
    for h in range(1, hops + 1):
        agg = directed.select("u", "v", "etype").join(values, on).groupBy("u", "etype").agg(
            *[F.avg(c).alias(c) for c in columns])
        level = agg.select(F.col("u").alias(node), "etype", F.lit(h).alias("hop"), *columns)
        out = level if out is None else out.unionByName(level)
        values, on = agg.withColumnRenamed("u", "v"), ["v", "etype"]
    return out


# ------------------------------------------------------- return probabilities

def _walk_block(pdf: pd.DataFrame, steps: int) -> pd.DataFrame:
    """diag(P^k), k=1..steps, of one cluster's start nodes, in column blocks. ``first`` and
    ``last`` bound the start nodes by their rank in the cluster.

    Where every edge goes both ways the walk is reversible, d_i P_ij = d_j P_ji, so diag(P^(a+b)) at i is
    the sum over j of P^a_ji P^b_ji d_j / d_i: half as many multiplications as steps."""
    nodes, idx = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    idx = idx.reshape(-1, 2)
    order = np.lexsort((idx[:, 1], idx[:, 0]))
    u, v = idx[order, 0], idx[order, 1]
    back = np.lexsort((u, v))
    both_ways = (u == v[back]).all() and (v == u[back]).all()
    n = len(nodes)
    degree = np.bincount(u, minlength=n)
    starts = np.concatenate([[0], np.cumsum(degree)[:-1]])
    has = degree > 0
    weight = (1.0 / np.maximum(degree, 1))[:, None]
    out = np.zeros((n, steps))
    block = int(max(1, min(n, 4_000_000 // max(len(u), 1))))
    first, last = int(pdf["first"].iloc[0]), min(int(pdf["last"].iloc[0]), n)

    def step(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        y[has] = np.add.reduceat(x[v], starts[has], axis=0)
        return y * weight

    for at in range(first, last, block):
        cols = np.arange(at, min(at + block, last))
        x = np.zeros((n, len(cols)))
        x[cols, np.arange(len(cols))] = 1.0
        if both_ways:
            for m in range(1, (steps + 1) // 2 + 1):
                y = step(x)
                scaled = y * (degree[:, None] / degree[cols])
                out[cols, 2 * m - 2] = (x * scaled).sum(0)
                if 2 * m <= steps:
                    out[cols, 2 * m - 1] = (y * scaled).sum(0)
                x = y
            continue
        for k in range(steps):
            x = step(x)
            out[cols, k] = x[cols, np.arange(len(cols))]
    res = pd.DataFrame(np.clip(out[first:last], 0.0, 1.0), columns=[f"rw{k}" for k in range(1, steps + 1)])
    res.insert(0, "node", nodes[first:last])
    return res


def walk_powers(edges: DataFrame, steps: int) -> list[DataFrame]:
    """Tables (i, j, p) of P^1 .. P^steps; long chains are cut in reliable storage."""
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    p1 = edges.join(degree, "u").groupBy(F.col("u").alias("i"), F.col("v").alias("j")).agg(
        F.sum(1.0 / F.col("d")).alias("p"))
    powers = [p1]
    step = p1.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("p").alias("q"))
    for m in range(2, steps + 1):
        nxt = powers[-1].join(step, "j").groupBy("i", F.col("k").alias("j")).agg(
            F.sum(F.col("p") * F.col("q")).alias("p"))
        powers.append(cut(nxt) if m % 2 == 0 and steps > 2 else nxt)
    return powers


def _returns_within(edges: DataFrame, steps: int, group: str) -> DataFrame:
    """(node, k, p) as below, for edges that never leave their ``group``.

    Edges are exchanged once, by group. A row (i, j) holds P^1..P^m at (i, j) in columns; as both joins and sums
    go by the group first, all powers up to half the steps are built where the edges lie.
    """
    half = (steps + 1) // 2
    # few edges a task, as a row of walks grows from each pair a few steps apart
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // WALK_EDGES))
    e = edges.select(F.col(group).alias("g"), "u", "v").repartition(tasks, "g")
    degree = e.groupBy("g", "u").agg(F.count(F.lit(1)).alias("d"))
    # a step stays for free: it carries the powers found so far
    hop = e.join(degree, ["g", "u"]).select("g", F.explode(F.array(
        F.struct("u", "v", (1.0 / F.col("d")).alias("q")), F.struct("u", F.col("u").alias("v"), F.lit(0.0).alias("q")))).alias("s"))
    hop = hop.groupBy("g", F.col("s.u").alias("j"), F.col("s.v").alias("k")).agg(F.sum("s.q").alias("q"))
    walks = hop.select("g", F.col("j").alias("i"), F.col("k").alias("j"), F.col("q").alias("p1"))
    for m in range(1, half):
        stay = F.col("j") == F.col("k")
        walks = walks.join(hop, ["g", "j"]).groupBy("g", "i", "k").agg(
            *[F.max(F.when(stay, F.col(f"p{x}")).otherwise(0.0)).alias(f"p{x}") for x in range(1, m + 1)],
            F.sum(F.col(f"p{m}") * F.col("q")).alias(f"p{m + 1}")).withColumnRenamed("k", "j")
    di, dj = (degree.select("g", F.col("u").alias(x), F.col("d").alias(f"d{x}")) for x in "ij")
    ratio = F.col("di") / F.col("dj")
    sums = walks.join(dj, ["g", "j"]).join(di, ["g", "i"]).groupBy("g", "i").agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("p1"))).alias("r1"),
        *[F.sum(F.col(f"p{(k + 1) // 2}") * F.col(f"p{k // 2}") * ratio).alias(f"r{k}") for k in range(2, steps + 1)])
    # by default a join of two keys is exchanged by both, even where its sides lie by the first
    conf, whole = edges.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(whole, "true")
    conf.set(whole, "false")
    try:
        sums = cut(sums)
    finally:
        conf.set(whole, before)
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("p")) for k in range(1, steps + 1)])
    return sums.select(F.col("i").alias("node"), F.explode(every).alias("r")).select("node", "r.k", "r.p")


def return_probabilities_by_join(edges: DataFrame, steps: int, group: str | None = None, most: int = WALK_BLOCK) -> DataFrame:
    """The same numbers from joins: (node, k, p). Needs edges in both directions.

    For an undirected graph d_i P_ij = d_j P_ji, so diag(P^(a+b)) at i is the sum
    over j of P^a_ij P^b_ij d_i / d_j: only half of the powers are built.

    ``group`` names a column of edges that never leave their group: groups of at most ``most`` ends of
    edges are then followed in place, and only larger ones have each power exchanged.
    """
    if group is not None:
        ends = edges.groupBy(group).agg(F.count_distinct("u").alias("n")).filter(F.col("n") > most).select(group)
        large = edges.join(ends, group, "left_semi")
        small = edges.join(ends, group, "left_anti")
        near = _returns_within(cut(small), steps, group)
        return near if large.isEmpty() else near.unionByName(return_probabilities_by_join(cut(large.select("u", "v")), steps))
    half = (steps + 1) // 2
    powers = walk_powers(edges, half)
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    di = degree.select(F.col("u").alias("i"), F.col("d").alias("di"))
    dj = degree.select(F.col("u").alias("j"), F.col("d").alias("dj"))
    out = powers[0].filter(F.col("i") == F.col("j")).select(
        F.col("i").alias("node"), F.lit(1).alias("k"), "p")
    for k in range(2, steps + 1):
        a, b = powers[(k + 1) // 2 - 1], powers[k // 2 - 1]
        joined = a.join(b.withColumnRenamed("p", "q"), ["i", "j"]).join(di, "i").join(dj, "j")
        out = out.unionByName(joined.groupBy(F.col("i").alias("node")).agg(
            F.sum(F.col("p") * F.col("q") * F.col("di") / F.col("dj")).alias("p")).select(
            "node", F.lit(k).alias("k"), "p"))
    return out


def random_walk_encoding(directed: DataFrame, clusters: DataFrame, steps: int = C.RWSE_STEPS,
                         node: str = "person_row", block: int = WALK_BLOCK) -> DataFrame:
    """Return probabilities rw1..rwN of every node within its cluster; isolated nodes are 0.

    A cluster's start nodes are cut into blocks, and each (cluster, block) gets the
    cluster's edges: one path for every size, without a table of node pairs.
    """
    ship_package(directed.sparkSession)
    # read twice below, so it is stored once
    intra = cut(intra_cluster_edges(directed, clusters, node).select("cluster", "u", "v"))
    sizes = intra.select("cluster", F.explode(F.array("u", "v")).alias("x")).groupBy("cluster").agg(
        F.count_distinct("x").alias("n"))
    starts = sizes.select("cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(block).cast("bigint")))
                          .alias("first"))
    schema = "node long, " + ", ".join(f"rw{k} double" for k in range(1, steps + 1))
    found = (intra.join(starts, "cluster").withColumn("last", F.col("first") + block)
             .groupBy("cluster", "first").applyInPandas(lambda pdf: _walk_block(pdf, steps), schema))
    found = found.withColumnRenamed("node", node)
    return clusters.select(node).join(found, node, "left").fillna(0.0, [f"rw{k}" for k in range(1, steps + 1)])
