from __future__ import annotations

import numpy as np
import pyarrow as pa

from siftlake.operators import components
from siftlake.operators.components import connected_components


def plain(edges):
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            least = min(low[u], low[v])
            changed = changed or low[u] != least or low[v] != least
            low[u] = low[v] = least
    return {x: r for x, r in low.items() if x != r}


def test_components_over_many_partitions(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 700, (500, 2))] + [(2000 + i, 2001 + i) for i in range(150)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    want = plain([e for e in edges if e[0] != e[1]])
    for parts in (1, 37):
        got = {r.node: r.component for r in connected_components(df.repartition(parts)).collect()}
        assert got == want
    assert connected_components(df.filter("a < 0")).count() == 0


def test_contraction_keeps_what_is_connected(monkeypatch):
    rng = np.random.default_rng(1)
    edges = np.sort(rng.integers(0, 400, (300, 2)), axis=1)[:, ::-1]
    edges = edges[edges[:, 0] != edges[:, 1]]
    batches = [pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"]) for part in np.array_split(edges, 20)]
    for held in (30, 10**6):
        monkeypatch.setattr(components, "HELD_NODES", held)
        found = [tuple(e.values()) for b in components._contract(batches) for e in b.to_pylist()]
        assert plain(found) == plain(list(map(tuple, edges.tolist()))) and all(u > v for u, v in found)
