import random

import numpy as np
import pytest

from wardline.config import FeatureConfig
from wardline.operators import graph


@pytest.fixture(params=["tabulated", "one hop at a time", "few rounds"])
def mode(request, monkeypatch):
    if request.param == "one hop at a time":
        monkeypatch.setattr(graph, "SMALL_GRAPH_HOSTS", 0)
    if request.param == "few rounds":
        monkeypatch.setattr(graph, "ONE_ROUND_PAIRS", 0)
    return request.param


def _hops(pairs):
    """Distances between connected hosts: the first power of the adjacency matrix that joins them."""
    hosts = sorted({h for p in pairs for h in p})
    links = np.eye(len(hosts), dtype=int)
    for a, b in pairs:
        links[hosts.index(a), hosts.index(b)] = links[hosts.index(b), hosts.index(a)] = 1
    powers = [np.linalg.matrix_power(links.astype(float), d) > 0 for d in range(len(hosts))]
    return {h: {t: next(d for d, p in enumerate(powers) if p[i, j]) for j, t in enumerate(hosts) if powers[-1][i, j]}
            for i, h in enumerate(hosts)}


def _graph(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(34)} | {(90, 91)}
    return pairs, spark.createDataFrame([(a, b, "k") for a, b in pairs], "src int, dst int, kind string")


def test_distances(spark, mode):
    pairs, edges = _graph(spark)
    hosts = spark.createDataFrame([(h,) for h in (0, 1, 2, 90, 77)], "host int")
    got = {(r["src"], r["dst"]): r["d"] for r in graph.distances(hosts, edges).collect()}
    hops = _hops(pairs)
    want = {(h, t): d for h in (0, 1, 2, 90, 77) for t, d in hops.get(h, {h: 0}).items()}
    assert got == want


def test_nearest_visited(spark, mode):
    pairs, edges = _graph(spark)
    rng = random.Random(6)
    rows, want, hops = [], {}, _hops(pairs)
    for user in range(12):
        hosts = rng.sample(list(range(40)) + [77, 90, 91], 9)
        for i, h in enumerate(hosts):
            rows.append((user, h, i // 2, user * 100 + i))
            if i:
                want[user * 100 + i] = min(hops.get(h, {}).get(o, 99) for o in hosts[:i])
    visits = spark.createDataFrame(rows, "user_id int, host int, us long, event_id int")
    got = {r["event_id"]: r["graph_dist_from_history"]
           for r in graph.nearest_visited(visits, edges, FeatureConfig()).collect()}
    assert got == want
