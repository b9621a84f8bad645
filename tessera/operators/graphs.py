"""Graphs as edge tables: degrees, triangles, curvature, PageRank, communities, blocks.

Undirected graphs are tables (src, dst) with src < dst, each edge once.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def with_degrees(edges: DataFrame) -> DataFrame:
    """(src, dst, ds, dd), the degrees of both ends, kept in the shared folder as several joins read it."""
    deg = degrees(edges)
    e = edges.select("src", "dst").join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src")
    return e.join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst").checkpoint()


def triangles(edges: DataFrame) -> DataFrame:
    """(src, dst, ds, dd, tri): degrees of the ends and triangles of each edge. Wedges are made at their lower-degree end only, so a hub makes few."""
    e = with_degrees(edges)
    flip = F.struct("dd", "dst") < F.struct("ds", "src")
    o = e.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("b"))
    x, y = o.select("a", F.col("b").alias("p")), o.select("a", F.col("b").alias("q"))
    wedge = x.join(y, "a").where("p < q")
    t = wedge.join(e.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"])
    sides = t.select(F.explode(F.array(*[F.struct(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst")) for u, v in (("a", "p"), ("a", "q"), ("p", "q"))])).alias("s"))
    n = sides.groupBy("s.src", "s.dst").agg(F.count("*").alias("tri"))
    return e.join(n, ["src", "dst"], "left").withColumn("tri", F.coalesce("tri", F.lit(0)))


def forman(edges: DataFrame) -> DataFrame:
    """(src, dst, curvature): 4 - both degrees + 3 * triangles."""
    return triangles(edges).select("src", "dst", (4 - F.col("ds") - F.col("dd") + 3 * F.col("tri")).cast("double").alias("curvature"))


def node_mean(edges: DataFrame, value: str) -> DataFrame:
    """(id, value): mean over the edges of each node."""
    v = edges.select(F.col("src").alias("id"), value).unionAll(edges.select(F.col("dst").alias("id"), value))
    return v.groupBy("id").agg(F.avg(value).alias(value))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, clustering): triangles over pairs of neighbours; 0 below degree 2."""
    end = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("ds").alias("degree")), F.struct(F.col("dst").alias("id"), F.col("dd").alias("degree"))))
    d = triangles(edges).select("tri", end.alias("e")).groupBy("e.id").agg((F.sum("tri") / 2).alias("t"), F.max("e.degree").alias("degree"))
    return d.select("id", F.when(F.col("degree") < 2, 0.0).otherwise(2 * F.col("t") / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) on an undirected graph after a fixed number of rounds; edges are dealt by source once, lineage is cut every few rounds."""
    e = both_ways(edges).repartition("src").checkpoint()
    deg = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).checkpoint()
    n = deg.count()
    r = deg.select("id", "degree", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        sent = e.join(r.select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("s")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("s").alias("s"))
        r = deg.join(sent, "id", "left").select("id", "degree", ((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            r = r.checkpoint()
    return r.select("id", "rank")


def neighbour_mean(edges: DataFrame, values: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(id, mean) over out-neighbours (active ones only, if given). ``values``: id, v."""
    v = values if active is None else values.join(active.select("id"), "id", "left_semi")
    return edges.join(v.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.avg("v").alias("mean"))


def cut_ratio(edges: DataFrame, block: DataFrame) -> DataFrame:
    """One row: share of edges whose ends lie in different blocks. ``block``: id, block."""
    a, b = block.select(F.col("id").alias("src"), F.col("block").alias("b1")), block.select(F.col("id").alias("dst"), F.col("block").alias("b2"))
    return edges.join(a, "src").join(b, "dst").agg(F.avg((F.col("b1") != F.col("b2")).cast("double")).alias("cut"))


def padding_waste(block: DataFrame, size: int) -> DataFrame:
    """One row: 1 - active / (blocks with active nodes * size). ``block``: id, block, active."""
    a = block.where("active")
    return a.agg((1 - F.try_divide(F.count("*"), F.count_distinct("block") * size)).alias("waste"))


def degree_entropy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entropy (nats) of the degree distribution; isolated nodes count in the total only."""
    n = nodes.count()
    d = degrees(edges).groupBy("degree").agg((F.count("*") / n).alias("p"))
    return d.agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: Gini coefficient. Ranks come from the values' own counts, not from one global window."""
    from .select import ranked

    r = ranked(df.withColumn("_neg", -F.col(value)).withColumn("_key", F.col("id")), "_neg", "_key")
    n, s = F.count("*"), F.sum(value)
    return r.agg((F.try_divide(2 * F.sum(F.col("rank") * F.col(value)), n * s) - F.try_divide(n + 1, n)).alias("gini"))


def modularity(edges: DataFrame, block: DataFrame) -> DataFrame:
    """One row: sum over blocks of inner edges / m - (degrees / 2m)**2."""
    a, b = block.select(F.col("id").alias("src"), F.col("block").alias("b1")), block.select(F.col("id").alias("dst"), F.col("block").alias("b2"))
    e = edges.join(a, "src").join(b, "dst")
    ends = e.select(F.explode(F.array("b1", "b2")).alias("b"), F.lit(0).alias("inner"))
    inside = e.where("b1 = b2").select(F.col("b1").alias("b"), F.lit(1).alias("inner"))
    per = ends.unionAll(inside).groupBy("b").agg(F.sum("inner").alias("l"), F.sum(1 - F.col("inner")).alias("d"))
    m = F.sum("d") / 2
    return per.agg((F.try_divide(F.sum("l"), m) - F.try_divide(F.sum(F.col("d") * F.col("d")), 4 * m * m)).alias("modularity"))


def cluster_sizes(block: DataFrame) -> DataFrame:
    s = block.groupBy("block").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), the smallest id reached: parts hook to their smallest neighbour, chains of hooks are halved until flat, edges shrink to those between parts.

    Tables of a round are written and read again, as estimates of sizes would double their digits round by round.
    """
    label = stored(nodes.select("id", F.col("id").alias("component")))
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"))
    for c in ("p", "q"):  # edges to what is no node lead nowhere
        e = e.join(label.select(F.col("id").alias(c)), c, "left_semi")
    e = stored(e.select("p", "q").distinct())
    while True:
        up = stored(e.groupBy(F.col("q").alias("part")).agg(F.min("p").alias("up")))
        if up.isEmpty():
            return label
        while True:
            above = up.select(F.col("part").alias("up"), F.col("up").alias("top"))
            up = stored(up.join(above, "up", "left").select("part", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            if up.where("moved").isEmpty():
                break
        to = lambda df, c: df.join(up.select(F.col("part").alias(c), F.col("up").alias("_up")), c, "left").withColumn(c, F.coalesce("_up", c)).drop("_up")
        label = stored(to(label, "component").select("id", "component"))
        e = stored(to(to(e, "p"), "q").where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct())


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int | None = 10) -> DataFrame:
    """(id, block): the most common label of the neighbours (smallest on ties, own label counts once), then split into connected parts.

    ``rounds`` None: until the labels have come before, which ends nodes that change places too.
    """
    e = stored(both_ways(edges))
    label, seen = nodes.select("id", F.col("id").alias("block")), set()
    for k in itertools.count() if rounds is None else range(rounds):
        votes = e.join(label.select(F.col("id").alias("dst"), "block"), "dst").select(F.col("src").alias("id"), "block").unionAll(label)
        c = votes.groupBy("id", "block").agg(F.count("*").alias("n"))
        label = c.groupBy("id").agg(F.max_by("block", F.struct("n", -F.col("block"))).alias("block"))
        if k % 3 == 2:
            label = stored(label)
            if rounds is None:
                state = label.agg(*[F.sum(F.xxhash64("id", "block", F.lit(i)).cast("decimal(38,0)")) for i in range(2)]).first()
                if state in seen:
                    break
                seen.add(state)
    a, b = label.select(F.col("id").alias("src"), F.col("block").alias("p")), label.select(F.col("id").alias("dst"), F.col("block").alias("q"))
    inner = edges.join(a, "src").join(b, "dst").where("p = q").select("src", "dst")
    return components(nodes, inner).withColumnRenamed("component", "block")


def topology_boost(units: DataFrame, rho: str = "rho", curvature: float = 0.3, hub: float = 0.2, bridge: float = 0.5) -> DataFrame:
    """rho * (1 + weighted structure signals), each signal over its largest value. Columns curv, hub, bridge."""
    top = units.agg(*[F.greatest(F.max(F.abs(c)), F.lit(1e-12)).alias(f"_{c}") for c in ("curv", "hub", "bridge")])
    part = lambda c: F.abs(c) / F.col(f"_{c}")
    f = 1 + curvature * part("curv") + hub * part("hub") + bridge * part("bridge")
    return units.join(F.broadcast(top)).withColumn("boosted", F.col(rho) * f).drop("_curv", "_hub", "_bridge")  # one row


def bfs_levels(seeds: DataFrame, e: DataFrame) -> tuple[DataFrame, int]:
    """(id, level) of all nodes that the seeds reach, and the number of levels. ``e``: id, dst both ways; a level's neighbours lie in it or next to it."""
    near = seeds.select("id", F.lit(0).alias("level")).checkpoint()
    seen, last, k = near, near.limit(0), 1
    while True:
        nxt = near.join(e, "id").select(F.col("dst").alias("id")).distinct()
        nxt = nxt.join(near.unionByName(last), "id", "left_anti").select("id", F.lit(k).alias("level")).checkpoint()
        if nxt.isEmpty():
            return seen, k
        seen, near, last = seen.unionByName(nxt), nxt, near
        k += 1
        if k % 32 == 0:
            seen = seen.checkpoint()


def bfs_blocks(nodes: DataFrame, edges: DataFrame, start: int, size: int) -> DataFrame:
    """(id, level, block): breadth-first levels, nodes numbered by component, level and id, cut into blocks.

    The component of ``start`` comes first and begins there; the others follow by their smallest id, begin at it
    and advance together. All go on to their ends.
    """
    from .select import ranked

    n, e = nodes.select("id").checkpoint(), both_ways(edges).withColumnRenamed("src", "id").checkpoint()
    seen, k = bfs_levels(n.where(F.col("id") == start), e)
    rest = n.join(seen, "id", "left_anti").checkpoint()
    x = seen.withColumn("_turn", F.lit(0).cast("long"))
    if not rest.isEmpty():
        inner = e.where("id < dst").join(rest, "id", "left_semi").select(F.col("id").alias("src"), "dst")
        comp = components(rest, inner)
        heads = comp.where("id = component")
        more, k2 = bfs_levels(heads, e)
        turn = ranked(heads.withColumn("_near", -F.col("component")), "_near", "component").select("component", F.col("rank").cast("long").alias("_turn"))
        x, k = x.unionByName(more.join(comp.join(turn, "component"), "id").select("id", "level", "_turn")), max(k, k2)
    r = ranked(x.withColumn("_near", -(F.col("_turn") * k + F.col("level"))), "_near", "id")  # each level is below k
    return r.select("id", "level", F.floor((F.col("rank") - 1) / size).cast("long").alias("block"))


def ollivier(edges: DataFrame, most: int | None = None, alpha: float = 0.5) -> DataFrame:
    """(src, dst, kappa): 1 - W1 of lazy walks at both ends, exact, for all edges, or the ``most`` of largest |Forman| (ties by ends).

    The transport problem of an edge has a few dozen nodes; its ball of two hops is one row, and tasks solve batches of rows.
    """
    pick = edges.select("src", "dst")
    if most is not None:
        pick = forman(edges).orderBy(F.desc(F.abs("curvature")), "src", "dst").limit(most).select("src", "dst")
    e = both_ways(edges)
    near = pick.select("src", "dst", F.explode(F.array("src", "dst")).alias("a")).join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a")
    hop2 = near.select("src", "dst", F.col("b").alias("a")).distinct().join(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a")
    ball = near.select("src", "dst", "a", "b").unionByName(hop2.select("src", "dst", "a", "b")).distinct()

    rows = ball.groupBy("src", "dst").agg(F.collect_list(F.array("a", "b")).alias("ball"))

    def solve(batches):
        import pandas as pd

        for x in batches:
            k = [1 - walk_distance(ball, s, t, alpha) for s, t, ball in zip(x["src"].tolist(), x["dst"].tolist(), x["ball"], strict=True)]
            yield pd.DataFrame({"src": x["src"], "dst": x["dst"], "kappa": pd.Series(k, dtype=float)})

    return rows.mapInPandas(solve, "src long, dst long, kappa double")


def walk_distance(pairs: list, s: int, t: int, alpha: float) -> float:
    """W1 between the lazy walks from s and t: successive shortest augmenting paths on the transport graph."""
    adj: dict[int, set[int]] = {}
    for a, b in pairs:
        a, b = int(a), int(b)
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    mass: dict[int, float] = {}
    for x, sign in ((s, 1.0), (t, -1.0)):
        mass[x] = mass.get(x, 0.0) + sign * alpha
        for y in adj[x]:
            mass[y] = mass.get(y, 0.0) + sign * (1 - alpha) / len(adj[x])
    give = {k: v for k, v in mass.items() if v > 1e-12}
    take = {k: -v for k, v in mass.items() if v < -1e-12}

    def steps(x):
        d, edge = {x: 0}, [x]
        while edge:
            edge = [v for u in edge for v in adj[u] if v not in d and not d.update({v: d[u] + 1})]
        return d

    dist = {u: steps(u) for u in give}
    flow: dict[tuple[int, int], float] = {}
    cost = 0.0
    while give and sum(give.values()) > 1e-9:
        best: dict = {("g", u): (0.0, None) for u in give if give[u] > 1e-12}
        for _ in range(2 * (len(dist) + len(take)) + 2):
            moved = False
            for u in dist:
                if ("g", u) in best:
                    for v in take:
                        c = best["g", u][0] + dist[u].get(v, 10**6)
                        if c < best.get(("t", v), (1e18,))[0] - 1e-12:
                            best["t", v], moved = (c, ("g", u)), True
            for (u, v), q in flow.items():
                if q > 1e-12 and ("t", v) in best:
                    c = best["t", v][0] - dist[u].get(v, 10**6)
                    if c < best.get(("g", u), (1e18,))[0] - 1e-12:
                        best["g", u], moved = (c, ("t", v)), True
            if not moved:
                break
        end = min((x for x in take if take[x] > 1e-12 and ("t", x) in best), key=lambda x: best["t", x][0], default=None)
        if end is None:
            break
        path, at = [], ("t", end)
        while best[at][1] is not None:
            path.append((best[at][1], at))
            at = best[at][1]
        q = min([give[at[1]], take[end]] + [flow[b[1], a[1]] for a, b in path if a[0] == "t"])
        for a, b in path:
            if a[0] == "g":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0.0) + q
            else:
                flow[b[1], a[1]] -= q
        cost += q * best["t", end][0]
        give[at[1]] -= q
        take[end] -= q
        give = {k: v for k, v in give.items() if v > 1e-12}
    return cost


def hierarchy_of(block: DataFrame, points: DataFrame) -> DataFrame:
    """(block, quadrant): quadrant of each community's centroid about the mean of all."""
    c = block.join(points, "id").groupBy("block").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    m = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return c.join(F.broadcast(m)).select("block", (F.when(F.col("y") >= F.col("my"), 2).otherwise(0) + F.when(F.col("x") >= F.col("mx"), 1).otherwise(0)).alias("quadrant"))  # one row


def heap_distance(u: Column, v: Column) -> Column:
    """Steps between two heap nodes through their lowest common ancestor: bits of the longer code below the common prefix."""
    a, b = (u + 1).cast("long"), (v + 1).cast("long")
    da, db = F.length(F.bin(a)), F.length(F.bin(b))
    d = F.least(da, db)
    apart = F.call_function("shiftright", a, da - d).bitwiseXOR(F.call_function("shiftright", b, db - d))
    below = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))
    return da + db - 2 * (d - below)


def contracted(edges: DataFrame, block: DataFrame) -> DataFrame:
    """(src, dst) of the blocks' graph: distinct pairs of blocks with an edge between them."""
    a, b = block.select(F.col("id").alias("src"), F.col("block").alias("p")), block.select(F.col("id").alias("dst"), F.col("block").alias("q"))
    e = edges.join(a, "src").join(b, "dst").where("p <> q")
    return e.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).distinct()


def community_tree(nodes: DataFrame, edges: DataFrame, levels: int | None = None, rounds: int | None = None) -> DataFrame:
    """(id, level, parent): communities by label propagation, contracted and grouped again until one block or no edge is left.

    Without ``levels`` and ``rounds`` both go on to their ends.
    """
    out, at, e = None, nodes.select("id"), edges
    for k in itertools.count() if levels is None else range(levels):
        b = label_propagation(at, e, rounds)
        step = b.select("id", F.lit(k).alias("level"), F.col("block").alias("parent"))
        out = step if out is None else out.unionByName(step)
        nxt = stored(b.select(F.col("block").alias("id")).distinct())
        if nxt.count() in (1, at.count()):
            break
        e, at = stored(contracted(e, b)), nxt
    return out


def greedy_blocks(edges: DataFrame, component: DataFrame, size: int) -> DataFrame:
    """(id, block): nodes taken one by one, next the one with most neighbours in the open block (smallest id on ties). Sequential inside each connected part."""
    e = both_ways(edges).join(component.select(F.col("id").alias("src"), "component"), "src")

    def one(pdf):
        import pandas as pd

        adj: dict[int, set[int]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            adj.setdefault(int(a), set()).add(int(b))
        free, out, block = set(adj), [], []
        near: dict[int, int] = {}
        while free:
            if len(block) == size:
                out.append(block)
                block, near = [], {}
            x = min(near, key=lambda v: (-near[v], v)) if near else min(free)
            free.discard(x)
            near.pop(x, None)
            block.append(x)
            for y in adj[x] & free:
                near[y] = near.get(y, 0) + 1
        out.append(block)
        return pd.DataFrame([(v, min(b)) for b in out for v in b], columns=["id", "block"])

    return e.groupBy("component").applyInPandas(one, "id long, block long")
