"""Breadth-first blocks reach every node, however far."""

from collections import deque

from tessera.operators import graphs


def bfs(ids, edges, start, size):
    adj = {i: set() for i in ids}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    level, turn = {}, {}
    for k, s in enumerate([start, *sorted(ids)]):
        if s in level:
            continue
        level[s], turn[s], todo = 0, k, deque([s])
        while todo:
            u = todo.popleft()
            for v in adj[u] - level.keys():
                level[v], turn[v] = level[u] + 1, k
                todo.append(v)
    order = sorted(ids, key=lambda i: (turn[i], level[i], i))
    return {i: (level[i], k // size) for k, i in enumerate(order)}


def test_bfs_blocks_go_to_the_end_of_every_component(spark):
    chain = [(i * 37) % 67 for i in range(67)]  # ids in no order along it
    edges = list(zip(chain, chain[1:], strict=False)) + [(80, 90), (90, 81), (75, 76)]
    ids = [*range(67), 75, 76, 80, 81, 90, 99]
    n = spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1)
    e = spark.createDataFrame([(min(x), max(x)) for x in edges], "src long, dst long").coalesce(1)
    got = {r["id"]: (r["level"], r["block"]) for r in graphs.bfs_blocks(n, e, 0, 5).collect()}
    assert got == bfs(ids, edges, 0, 5)
    assert max(x for x, _ in got.values()) == 66
