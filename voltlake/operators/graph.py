"""Graphs from edge tables: edges, degrees, centralities."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Edges of the largest graph whose centralities are computed on the driver; of the largest that every executor holds, each
#: taking some sources; and (source, node) pairs of a block of sources in larger graphs, which stay tables.
DRIVER_EDGES, SHARED_EDGES, BLOCK_PAIRS = 10_000, 1_000_000, 100_000_000


def active_lines(df: DataFrame, active_only: bool = True) -> DataFrame:
    """line_id, from_bus, to_bus, in_service. A missing in_service is an error, not true."""
    rows = df.select(F.col("line_id").cast("long").alias("line_id"), F.col("from_bus").cast("long").alias("from_bus"), F.col("to_bus").cast("long").alias("to_bus"), F.col("in_service").cast("boolean").alias("in_service"))
    return rows.where("in_service") if active_only else rows


def edges(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """(src, dst) with src < dst, once each; edges without an end and loops are left out."""
    a, b = F.col(ends[0]).cast("long"), F.col(ends[1]).cast("long")
    return df.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()


def nodes(graph: DataFrame, more: DataFrame | None = None, node: str = "node") -> DataFrame:
    out = graph.select(F.col("src").alias("node")).union(graph.select("dst"))
    if more is not None:
        out = out.union(more.select(F.col(node).cast("long")).where(F.col(node).isNotNull()))
    return out.distinct()


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.select("src", "dst").union(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(graph: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, node_degree, node_weighted_degree): edges have no weight, so both are counts."""
    counted = both_ways(graph).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("node_degree"))
    if all_nodes is not None:
        counted = all_nodes.select("node").join(counted, "node", "left").withColumn("node_degree", F.coalesce("node_degree", F.lit(0)))
    return counted.withColumn("node_weighted_degree", F.col("node_degree").cast("double"))


def clustering(graph: DataFrame) -> DataFrame:
    """(node, local_clustering_coefficient): triangles from wedges below their middle, by edges from the smaller degree."""
    e = graph.select("src", "dst")
    wedge = e.alias("x").join(e.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    third = wedge.join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), ["a", "c"])
    counted = third.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    d = F.col("node_degree")
    value = F.when(d > 1, 2 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return degrees(graph).join(counted, "node", "left").select("node", value.alias("local_clustering_coefficient"))


def pagerank(graph: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(node, pagerank) after a fixed number of rounds from the uniform distribution."""
    links = checkpointed(both_ways(graph).join(degrees(graph).select(F.col("node").alias("src"), "node_degree"), "src"))
    ranks = checkpointed(nodes(graph))
    n = max(1, ranks.count())
    ranks = ranks.withColumn("pagerank", F.lit(1.0 / n))
    for i in range(iterations):
        got = links.join(ranks, links["src"] == ranks["node"]).groupBy(links["dst"].alias("node")).agg(F.sum(F.col("pagerank") / F.col("node_degree")).alias("got"))
        ranks = got.select("node", ((1 - damping) / n + damping * F.col("got")).alias("pagerank"))
        if i % 5 == 4:
            ranks = checkpointed(ranks)
    return ranks


def connected_components(graph: DataFrame) -> DataFrame:
    """(node, component): the smallest node within reach. Large-star and small-star rounds until nothing changes, cut twice each."""
    links = checkpointed(graph.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        links = checkpointed(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return nodes(graph).join(links, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
        before = now


# --- centralities over shortest paths and eigenvectors


def _adjacency(pairs: list[tuple[int, int]], more: list[int] = ()) -> tuple[list[int], list[list[int]]]:
    names = sorted({x for p in pairs for x in p} | set(more))
    at, out = {x: i for i, x in enumerate(names)}, [[] for _ in names]
    for a, b in pairs:
        out[at[a]].append(at[b])
        out[at[b]].append(at[a])
    return names, out


def _from_source(near: list[list[int]], s: int) -> tuple[np.ndarray, dict[tuple[int, int], float], list[int]]:
    """Dependencies of nodes and edges on the paths from s, and distances (-1: out of reach)."""
    n = len(near)
    distance, paths, order, dep, on_edge = [-1] * n, [0.0] * n, [], np.zeros(n), {}
    distance[s], paths[s], queue = 0, 1.0, deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if distance[w] < 0:
                distance[w] = distance[v] + 1
                queue.append(w)
            if distance[w] == distance[v] + 1:
                paths[w] += paths[v]
    for w in reversed(order):
        for v in near[w]:
            if distance[v] == distance[w] - 1:
                share = paths[v] / paths[w] * (1 + dep[w])
                on_edge[min(v, w), max(v, w)] = on_edge.get((min(v, w), max(v, w)), 0.0) + share
                dep[v] += share
    dep[s] = 0.0
    return dep, on_edge, distance


def _ends(near: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(near)), [len(a) for a in near]), np.array([b for a in near for b in a], int)


def _eigenvector(near: list[list[int]], rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    (src, dst), n = _ends(near), len(near)
    x = np.full(n, 1 / max(1, n))
    for _ in range(rounds):
        y = x + np.bincount(src, x[dst], n)
        y /= np.linalg.norm(y) or 1.0
        if np.abs(y - x).sum() < n * tolerance:
            return y
        x = y
    return np.full(n, np.nan)


def _pagerank(near: list[list[int]], damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    (src, dst), n = _ends(near), len(near)
    x, out = np.full(n, 1 / max(1, n)), np.array([len(a) for a in near], float)
    for _ in range(rounds):
        give = np.divide(x, out, out=np.zeros(n), where=out > 0)
        y = damping * (np.bincount(src, give[dst], n) + x[out == 0].sum() / n) + (1 - damping) / n
        if np.abs(y - x).sum() < n * tolerance:
            return y
        x = y
    return x


def _from_sources(near: list[list[int]], sources: list[int]) -> tuple[np.ndarray, dict[int, float], dict[tuple[int, int], float]]:
    """Summed dependencies of nodes and edges, and the closeness of each source."""
    n = len(near)
    between, close, on_edge = np.zeros(n), {}, {}
    for s in sources:
        dep, edge, distance = _from_source(near, s)
        between += dep
        for k, v in edge.items():
            on_edge[k] = on_edge.get(k, 0.0) + v
        reach = [d for d in distance if d > 0]
        close[s] = (len(reach) / sum(reach)) * (len(reach) / (n - 1)) if reach and n > 1 else 0.0
    return between, close, on_edge


def _on_executors(spark: SparkSession, near: list[list[int]]) -> tuple[np.ndarray, dict[int, float], dict[tuple[int, int], float]]:
    """_from_sources() of all nodes: each executor holds the graph, the sources are dealt out."""
    ship(spark)
    n, shared = len(near), spark.sparkContext.broadcast(near)

    def run(batches):
        for df in batches:
            between, close, on_edge = _from_sources(shared.value, df["id"].tolist())
            yield pd.DataFrame([(0, i, -1, float(between[i])) for i in np.flatnonzero(between).tolist()] + [(1, i, -1, v) for i, v in close.items()] + [(2, a, b, v) for (a, b), v in on_edge.items()], columns=["kind", "a", "b", "value"])

    parts = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    rows = spark.range(0, n, 1, parts).mapInPandas(run, "kind int, a long, b long, value double").groupBy("kind", "a", "b").agg(F.sum("value").alias("value"))
    between, close, on_edge = np.zeros(n), {}, {}
    for r in rows.toLocalIterator():
        if r["kind"] == 0:
            between[r["a"]] = r["value"]
        elif r["kind"] == 1:
            close[r["a"]] = r["value"]
        else:
            on_edge[r["a"], r["b"]] = r["value"]
    return between, close, on_edge


def centralities(pairs: list[tuple[int, int]], more: list[int] = (), spark: SparkSession | None = None, tolerance: float = 1e-6) -> tuple[dict[int, dict[str, float]], dict[tuple[int, int], float]]:
    """Centralities of nodes, and edge betweenness; the paths from each source on the executors if spark is given."""
    names, near = _adjacency(pairs, more)
    n = len(names)
    if not n:
        return {}, {}
    between, close, on_edge = _on_executors(spark, near) if spark else _from_sources(near, range(n))
    eigen, rank = _eigenvector(near, tolerance=tolerance), _pagerank(near)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    of = {x: {"betweenness_centrality": float(between[i] * scale), "closeness_centrality": float(close[i]), "eigenvector_centrality": float(eigen[i]), "pagerank": float(rank[i])} for i, x in enumerate(names)}
    return of, {(names[a], names[b]): v / (n * (n - 1)) for (a, b), v in on_edge.items()}


def path_levels(links: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """(s, v, paths) of the nodes v at 0, 1, 2 .. steps from each source, and how many shortest paths lead there."""
    levels = [checkpointed(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))]
    last = levels[0].limit(0)
    while True:
        front = levels[-1]
        near = front.join(links, front["v"] == links["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        step = checkpointed(near.join(front.select("s", "v").union(last.select("s", "v")), ["s", "v"], "left_anti"))
        if step.isEmpty():
            return levels
        last = front
        levels.append(step)


def path_shares(graph: DataFrame, more: list[int] = ()) -> tuple[DataFrame, DataFrame]:
    """(node, share) and (src, dst, share): the shares of shortest paths over nodes and edges, summed over all pairs of ends, for
    a graph of any size: sources go in blocks, levels of paths are tables, and shares go back level by level."""
    spark, links, ids = graph.sparkSession, checkpointed(both_ways(graph)), checkpointed(_all_nodes(graph, more))
    blocks = max(1, -(-ids.count() ** 2 // BLOCK_PAIRS))
    on_node, on_edge = spark.createDataFrame([], "node long, share double"), spark.createDataFrame([], "src long, dst long, share double")
    for block in range(blocks):
        levels = path_levels(links, ids.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block))
        dep = levels[-1].withColumn("dep", F.lit(0.0))
        for before in reversed(levels[:-1]):
            on_node = checkpointed(on_node.union(dep.select("v", "dep")).groupBy("node").agg(F.sum("share").alias("share")))
            back = dep.join(links, dep["v"] == links["src"]).select("s", F.col("v").alias("w"), F.col("dst").alias("v"), ((1 + F.col("dep")) / F.col("paths")).alias("each"))
            shares = checkpointed(back.join(before, ["s", "v"]).select("s", "v", "w", (F.col("paths") * F.col("each")).alias("share")))
            on_edge = checkpointed(on_edge.union(shares.select(F.least("v", "w"), F.greatest("v", "w"), "share")).groupBy("src", "dst").agg(F.sum("share").alias("share")))
            dep = checkpointed(before.join(shares.groupBy("s", "v").agg(F.sum("share").alias("dep")), ["s", "v"], "left").select("s", "v", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep")))
    return on_node, on_edge


def eigenvector(graph: DataFrame, more: list[int] = (), rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(node, eigenvector_centrality) by power iteration over tables; null if it doesn't converge."""
    links, ids = checkpointed(both_ways(graph)), checkpointed(_all_nodes(graph, more))
    n = ids.count()
    x = ids.withColumn("x", F.lit(1.0 / max(1, n)))
    for _ in range(rounds):
        got = links.join(x, links["dst"] == x["node"]).groupBy(links["src"].alias("node")).agg(F.sum("x").alias("got"))
        y = checkpointed(x.join(got, "node", "left").select("node", "x", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("y")))
        norm = (y.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 1.0) ** 0.5
        off = y.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0] or 0.0
        x = y.select("node", (F.col("y") / norm).alias("x"))
        if off < n * tolerance or not n:
            return x.withColumnRenamed("x", "eigenvector_centrality")
    return ids.withColumn("eigenvector_centrality", F.lit(None).cast("double"))


def _converged_pagerank(graph: DataFrame, more: list[int], damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    ids = checkpointed(degrees(graph, _all_nodes(graph, more)).select("node", "node_degree"))
    links, n = checkpointed(both_ways(graph)), ids.count()
    x = ids.withColumn("x", F.lit(1.0 / max(1, n)))
    for _ in range(rounds):
        loose = x.agg(F.sum(F.when(F.col("node_degree") == 0, F.col("x")))).first()[0] or 0.0
        got = links.join(x, links["src"] == x["node"]).groupBy(links["dst"].alias("node")).agg(F.sum(F.col("x") / F.col("node_degree")).alias("got"))
        y = checkpointed(x.join(got, "node", "left").select("node", "node_degree", "x", (damping * (F.coalesce("got", F.lit(0.0)) + loose / n) + (1 - damping) / n).alias("y")))
        off = y.agg(F.sum(F.abs(F.col("y") - F.col("x")))).first()[0] or 0.0
        x = y.select("node", "node_degree", F.col("y").alias("x"))
        if off < n * tolerance:
            break
    return x.select("node", F.col("x").alias("pagerank"))


def _all_nodes(graph: DataFrame, more: list[int]) -> DataFrame:
    return nodes(graph, graph.sparkSession.createDataFrame([(int(x),) for x in more], "node long"))


def _small(graph: DataFrame, more: list[int], tolerance: float = 1e-6):
    """centralities() of a graph that fits an executor, or None."""
    n = graph.count()
    if n > SHARED_EDGES:
        return None
    pairs = [(r["src"], r["dst"]) for r in graph.select("src", "dst").toLocalIterator()]
    return centralities(pairs, more, graph.sparkSession if n > DRIVER_EDGES else None, tolerance)


NODE_CENTRALITIES = ("betweenness_centrality", "closeness_centrality", "eigenvector_centrality", "pagerank")


def node_features(graph: DataFrame, more: list[int] = (), tolerance: float = 1e-6) -> DataFrame:
    """All node centralities. A graph of up to DRIVER_EDGES edges is on the driver, of up to SHARED_EDGES on each executor, a
    larger one in tables; the values are the same."""
    spark: SparkSession = graph.sparkSession
    small = _small(graph, more, tolerance)
    if small is None:
        shares, ids = path_shares(graph, more)[0], checkpointed(_all_nodes(graph, more))
        n = ids.count()
        between = ids.join(shares, "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) / max(1, (n - 1) * (n - 2))).alias("betweenness_centrality"))
        found = between.join(closeness(graph, more), "node").join(eigenvector(graph, more, tolerance=tolerance), "node").join(_converged_pagerank(graph, more), "node")
    else:
        found = spark.createDataFrame([(k, *(v[c] for c in NODE_CENTRALITIES)) for k, v in small[0].items()], "node long, " + ", ".join(f"{c} double" for c in NODE_CENTRALITIES))
    return degrees(graph, found).join(found, "node").join(clustering(graph), "node", "left").withColumn("local_clustering_coefficient", F.coalesce("local_clustering_coefficient", F.lit(0.0)))


def edge_features(graph: DataFrame) -> DataFrame:
    """(src, dst, degrees of both ends, edge_betweenness_centrality)."""
    spark: SparkSession = graph.sparkSession
    small = _small(graph, [])
    if small is None:
        n = nodes(graph).count()
        between = path_shares(graph)[1].select("src", "dst", (F.col("share") / (n * (n - 1))).alias("edge_betweenness_centrality"))
    else:
        between = spark.createDataFrame([(a, b, float(v)) for (a, b), v in small[1].items()], "src long, dst long, edge_betweenness_centrality double")
    d = degrees(graph).select("node", "node_degree")
    return graph.join(d.select(F.col("node").alias("src"), F.col("node_degree").alias("from_bus_degree")), "src").join(d.select(F.col("node").alias("dst"), F.col("node_degree").alias("to_bus_degree")), "dst").join(between, ["src", "dst"]).select("src", "dst", "from_bus_degree", "to_bus_degree", "edge_betweenness_centrality")


def closeness(graph: DataFrame, more: list[int] = ()) -> DataFrame:
    """(node, closeness_centrality) by breadth-first rounds over (source, node) pairs, on the executors, until no pair is new;
    sources go in blocks, so that at most BLOCK_PAIRS pairs are held. A neighbour of the last round's front is new unless it
    is in that front or the one before."""
    links, ids = checkpointed(both_ways(graph)), checkpointed(_all_nodes(graph, more))
    n = ids.count()
    blocks, found = max(1, -(-(n**2) // BLOCK_PAIRS)), None
    for block in range(blocks):
        own = ids if blocks == 1 else ids.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
        front = own.select(F.col("node").alias("s"), F.col("node").alias("v"))
        last, k = front.limit(0), 0
        sums = own.select(F.col("node").alias("s"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("d"))
        while True:
            k += 1
            near = front.join(links, front["v"] == links["src"]).select("s", F.col("dst").alias("v")).distinct()
            step = checkpointed(near.join(front.union(last), ["s", "v"], "left_anti"))
            if step.isEmpty():
                break
            met = step.groupBy("s").agg(F.count("*").alias("more"))
            more_met = F.coalesce("more", F.lit(0))
            sums = checkpointed(sums.join(met, "s", "left").select("s", (F.col("r") + more_met).alias("r"), (F.col("d") + k * more_met).alias("d")))
            last, front = front, step
        found = sums if found is None else checkpointed(found.union(sums))
    return found.select(F.col("s").alias("node"), (F.coalesce(F.try_divide("r", "d"), F.lit(0.0)) * F.try_divide("r", F.lit(n - 1))).alias("closeness_centrality"))
