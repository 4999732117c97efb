"""The neighbour graph against brute force: recall, links, saving, shards and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from brambleflow.operators import dense, hnsw
from brambleflow.sources.config import shared_folder


def points(n, size, clusters, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) if not clusters else rng.normal(size=(clusters, size))[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, size))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, x, key="item_id"):
    return spark.createDataFrame([(f"i{k}", v.tolist(), "x", 1) for k, v in enumerate(x)], f"{key} string, v array<float>, ids string, shard int")


@pytest.mark.parametrize(("n", "size", "clusters", "most_scored"), [(1500, 32, 0, 1.0), (3000, 16, 60, 0.3), (600, 8, 3, 1.0)])
def test_walks_find_what_brute_force_finds(n, size, clusters, most_scored):
    x = points(n, size, clusters, n)
    graph = hnsw.build_graph(x, hnsw.node_layers([str(i) for i in range(n)]))
    queries, graph.scored = points(200, size, clusters, n), 0
    found, sims = graph.search(queries, 10)
    want = np.argsort(-(queries @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, want, strict=True)]) >= 9.5
    assert np.allclose(sims, np.take_along_axis(queries @ x.T, found, 1), atol=1e-5) and (np.diff(sims) <= 0).all()
    assert graph.scored / (n * 200) < most_scored


def test_links_stay_within_their_bounds_and_layers():
    x = points(800, 12, 0, 3)
    tops = hnsw.node_layers([str(i) for i in range(800)], 6)
    graph = hnsw.build_graph(x, tops, links=6, ef=20)
    assert len(graph.layers) == tops.max() + 1 and tops[graph.entry] == tops.max()
    for layer, links in enumerate(graph.layers):
        assert links.shape[1] == (12 if layer == 0 else 6)
        for node, own in enumerate(links):
            own = own[own >= 0]
            assert len(set(own.tolist())) == len(own) and node not in own
            assert tops[node] >= layer if len(own) else tops[node] < layer or (tops >= layer).sum() == 1
            assert (tops[own] >= layer).all()
    # From the entry every node of the lowest layer is reached.
    reached, new = {graph.entry}, {graph.entry}
    while new:
        new = {int(b) for a in new for b in graph.layers[0][a] if b >= 0} - reached
        reached |= new
    assert len(reached) == 800


def test_saved_index_of_several_shards(spark):
    x = points(900, 16, 20, 5)
    items, queries = table(spark, x), table(spark, x[:120], "query_id")
    path = shared_folder(spark, "graph")
    hnsw.save_index(items.repartition(5), path, shard_items=250)
    index = hnsw.open_index(spark, path)
    assert index.count() == 4
    got = hnsw.search_index(index, queries, 5, skip_same=True)
    want = dense.cosine_top_k(queries, items, 5, skip_same=True)
    assert got.columns == want.columns and got.count() == 600
    assert got.join(want, ["query_id", "item_id", "score"], "left_semi").count() >= 0.95 * 600
    again = shared_folder(spark, "graph")
    hnsw.save_index(items.coalesce(1), again, shard_items=250)
    order = ["query_id", "rank"]
    assert hnsw.search_index(hnsw.open_index(spark, again), queries, 5, skip_same=True).orderBy(order).collect() == got.orderBy(order).collect()


def test_shards_pass_by_the_queries_of_a_task(spark):
    x = points(900, 16, 20, 5)
    items, queries = table(spark, x), table(spark, x, "query_id").repartition(8)
    path = shared_folder(spark, "graph")
    hnsw.save_index(items, path, shard_items=250)
    index = hnsw.open_index(spark, path)
    assert index.count() == 4
    walked = hnsw.found_by_walks(index, queries, 6)
    # Not six rows for each of four shards.
    assert 900 * 6 <= walked.count() < 900 * 6 * 1.05
    best = {(r.query_id, r["rank"]): r.item_id for r in hnsw.ranked(walked.select("query_id", "item_id", "score"), ["query_id"], 6).collect()}
    graphs, scored = [(hnsw._graph(row.asDict()), row.ids) for row in index.collect()], walked.agg({"scored": "sum"}).first()[0]
    found = [graph.search(x, 6) for graph, _ in graphs]
    assert abs(scored / sum(graph.scored for graph, _ in graphs) - 1) < 0.01
    for q in range(0, 900, 50):
        each = [(-round(float(x[q].astype(float) @ graph.vectors[i].astype(float)), 6), ids[i]) for (graph, ids), (at, _) in zip(graphs, found, strict=True) for i in at[q] if i >= 0]
        assert [best[f"i{q}", r + 1] for r in range(6)] == [i for _, i in sorted(each)[:6]]


def test_index_of_odd_rows(spark):
    none = spark.createDataFrame([], "item_id string, v array<float>")
    path = shared_folder(spark, "graph")
    hnsw.save_index(none, path)
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), (None, [1.0, 1.0])], "query_id string, v array<float>")
    assert hnsw.search_index(hnsw.open_index(spark, path), queries, 3).count() == 0
    items = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 3.0]), ("b", [1.0, 1.0]), ("c", None), ("d", [0.0, 0.0]), (None, [1.0, 0.0])], "item_id string, v array<float>")
    hnsw.save_index(items, path)
    found = hnsw.search_index(hnsw.open_index(spark, path), queries, 10).collect()
    assert [(r.query_id, r.item_id, r.score, r["rank"]) for r in found] == [("q", "a", 1.0, 1), ("q", "b", 0.707107, 2), ("q", "a", 0.0, 3)]
