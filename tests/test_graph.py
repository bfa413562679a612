"""Centralities: all nodes of the 33-bus network, long paths, and the same values however large the graph is taken to be."""

import numpy as np
import pytest
from test_golden import LINES

from voltlake.operators import graph

#: Published centralities of the benchmark network's nodes, 0 to 32, to seven digits.
BETWEENNESS = [0.0, 0.1670027, 0.1841398, 0.06754032, 0.08501344, 0.249328, 0.2150538, 0.3256048, 0.2631048, 0.03931452, 0.008064516, 0.07224462, 0.03494624, 0.04905914, 0.2331989, 0.1622984, 0.1381048, 0.1179435, 0.1377688, 0.1498656, 0.2291667, 0.08870968, 0.1260081, 0.1078629, 0.1048387, 0.141129, 0.1169355, 0.1028226, 0.1891801, 0.1263441, 0.1115591, 0.1058468, 0.1068548]
CLOSENESS = [0.171123, 0.2051282, 0.2051282, 0.2, 0.2133333, 0.238806, 0.2406015, 0.25, 0.2352941, 0.1987578, 0.180791, 0.1916168, 0.1787709, 0.1860465, 0.2162162, 0.1975309, 0.183908, 0.173913, 0.2051282, 0.2147651, 0.2335766, 0.2012579, 0.1916168, 0.1818182, 0.1797753, 0.2162162, 0.2, 0.1916168, 0.1904762, 0.1767956, 0.1702128, 0.1684211, 0.1684211]
EIGENVECTOR = [0.04492358, 0.1097676, 0.1031357, 0.08585358, 0.1066416, 0.1747206, 0.2272289, 0.3805115, 0.3735472, 0.2352185, 0.2012116, 0.2564442, 0.1858188, 0.1976066, 0.2970355, 0.1546558, 0.08086809, 0.04294649, 0.1201509, 0.1838171, 0.3290044, 0.2395938, 0.05638233, 0.03462864, 0.02822814, 0.09305476, 0.05265531, 0.03560528, 0.03434246, 0.02007738, 0.01471353, 0.01587334, 0.02407205]
PAGERANK = [0.01628087, 0.04141795, 0.03971688, 0.02733375, 0.02714321, 0.03875327, 0.02588937, 0.03657531, 0.03683362, 0.02625543, 0.0265272, 0.03819964, 0.02669807, 0.02665849, 0.0379969, 0.02749741, 0.02867138, 0.02927174, 0.0277214, 0.02691809, 0.03738254, 0.0259599, 0.02780876, 0.02825966, 0.02798978, 0.02745958, 0.02807777, 0.0279129, 0.0403533, 0.02835403, 0.02911559, 0.0294606, 0.02950559]


def _network(spark):
    return graph.edges(spark.createDataFrame(LINES, "a long, b long"), ("a", "b"))


def _path(spark, n):
    return graph.edges(spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long"), ("a", "b"))


def _sized(monkeypatch, sizes):
    for name, value in zip(("DRIVER_EDGES", "SHARED_EDGES", "BLOCK_PAIRS"), sizes):
        monkeypatch.setattr(graph, name, value)


@pytest.mark.parametrize("sizes", [(10**6, 10**6, 10**8), (0, 10**6, 10**8)], ids=["driver", "executors"])
def test_all_nodes_of_the_benchmark_network(spark, monkeypatch, sizes):
    _sized(monkeypatch, sizes)
    node = {r["node"]: r for r in graph.node_features(_network(spark)).collect()}
    assert sorted(node) == list(range(33))
    for name, want in (("betweenness_centrality", BETWEENNESS), ("closeness_centrality", CLOSENESS), ("eigenvector_centrality", EIGENVECTOR), ("pagerank", PAGERANK)):
        assert [node[i][name] for i in range(33)] == pytest.approx(want, rel=1e-5)


def test_paths_of_the_benchmark_network_in_tables(spark):
    n = 33
    node, edge = ({tuple(r)[:-1]: r["share"] for r in t.collect()} for t in graph.path_shares(_network(spark)))
    assert [node.get((i,), 0.0) / ((n - 1) * (n - 2)) for i in range(n)] == pytest.approx(BETWEENNESS, rel=1e-5)
    assert {k: v / (n * (n - 1)) for k, v in edge.items()} == pytest.approx({(r["src"], r["dst"]): r["edge_betweenness_centrality"] for r in graph.edge_features(_network(spark)).collect()})


def test_path(spark):
    """A path of n nodes, by formula."""
    n = 200
    node = {r["node"]: r for r in graph.node_features(_path(spark, n)).collect()}
    for i in range(n):
        assert node[i]["betweenness_centrality"] == pytest.approx(2 * i * (n - 1 - i) / ((n - 1) * (n - 2)))
        assert node[i]["closeness_centrality"] == pytest.approx((n - 1) / sum(abs(i - j) for j in range(n)))
    edge = {r["src"]: r["edge_betweenness_centrality"] for r in graph.edge_features(_path(spark, n)).collect()}
    assert edge == pytest.approx({i: 2 * (i + 1) * (n - 1 - i) / (n * (n - 1)) for i in range(n - 1)})


@pytest.mark.parametrize("sizes", [(0, 10**6, 10**8), (0, 0, 40)], ids=["executors", "blocks of tables"])
def test_parts_and_lone_nodes(spark, monkeypatch, sizes):
    g = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (5, 6)], "src long, dst long")
    want = {r["node"]: r for r in graph.node_features(g, [9]).collect()}
    _sized(monkeypatch, sizes)
    for r in graph.node_features(g, [9]).collect():
        assert [x for x in r][1:] == pytest.approx([x for x in want[r["node"]]][1:])
    assert want[9]["closeness_centrality"] == 0.0 and want[9]["node_degree"] == 0


def test_empty_graph(spark):
    g = spark.createDataFrame([], "src long, dst long")
    assert graph.node_features(g).count() == graph.edge_features(g).count() == graph.pagerank(g).count() == graph.connected_components(g).count() == 0
    assert np.isfinite(graph.closeness(g).count())
