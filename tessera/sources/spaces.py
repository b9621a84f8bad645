"""Spaces: cells or nodes with a reference value ``gt``, a coarse value, and the unit they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import morton
from .tables import table


def grid_cells(values: DataFrame, side: int, tile: int) -> DataFrame:
    """A square grid from (r, c, gt); cells without a value hold 0. Columns r, c, ti, tj, unit, gt, coarse (tile mean)."""
    spark = values.sparkSession
    n = side // tile
    frame = spark.range(side * side).select((F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c"))
    cells = frame.join(values, ["r", "c"], "left").withColumn("gt", F.coalesce("gt", F.lit(0.0)))
    ti, tj = (F.floor(F.col(x) / tile).cast("int") for x in ("r", "c"))
    cells = cells.withColumns({"ti": ti, "tj": tj}).withColumn("unit", F.col("ti") * n + F.col("tj"))
    return cells.withColumn("coarse", F.avg("gt").over(Window.partitionBy("unit"))).select("r", "c", "ti", "tj", "unit", "gt", "coarse")


def sales_grid(spark: SparkSession, sf_dir: str, side: int = 32, tile: int = 4) -> DataFrame:
    """Scalar grid of mean net line prices (in ten thousands) by order and part key modulo the side."""
    li = table(spark, sf_dir, "lineitem")
    r, c = ((F.col(k) % side).cast("int") for k in ("l_orderkey", "l_partkey"))
    price = F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 10000
    return grid_cells(li.groupBy(r.alias("r"), c.alias("c")).agg(price.alias("gt")), side, tile)


def event_grid(spark: SparkSession, sf_dir: str, tile: int = 4) -> DataFrame:
    """Scalar grid of mean event values by day of month and hour, 32 x 32."""
    ev = table(spark, sf_dir, "events")
    v = ev.groupBy(F.dayofmonth("ts").alias("r"), F.hour("ts").alias("c")).agg((F.avg("value") / 100).alias("gt"))
    return grid_cells(v, 32, tile)


def vector_cells(spark: SparkSession, sf_dir: str, width: int = 20, tile: int = 5) -> DataFrame:
    """Vector grid of embeddings, exploded: r, c, ti, tj, unit, d, gt, coarse (tile mean of each channel)."""
    e = table(spark, sf_dir, "embeddings")
    cell = e.select((F.col("vec_id") / width).cast("int").alias("r"), (F.col("vec_id") % width).cast("int").alias("c"), F.posexplode("embedding").alias("d", "x"))
    ti, tj = (F.floor(F.col(x) / tile).cast("int") for x in ("r", "c"))
    cell = cell.withColumns({"ti": ti, "tj": tj, "gt": F.col("x").cast("double")}).withColumn("unit", F.col("ti") * (width // tile) + F.col("tj"))
    return cell.withColumn("coarse", F.avg("gt").over(Window.partitionBy("unit", "d"))).select("r", "c", "ti", "tj", "unit", "d", "gt", "coarse")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph vertices of embeddings: id, x, y (first two dimensions), gt (the third), community (label), coarse (its mean)."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    v = e.select(F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("gt"), F.col("label").alias("community"))
    return v.withColumn("coarse", F.avg("gt").over(Window.partitionBy("community")))


def depth_of(node: Column) -> Column:
    """Depth in a heap whose root is node 0."""
    return F.length(F.bin(node + 1)) - 1


def tree_nodes(spark: SparkSession, sf_dir: str, unit_depth: int = 3) -> DataFrame:
    """Binary heap over the keys of all orders: id, parent, depth, gt (total price in hundred thousands), unit (ancestor at the unit depth), coarse.

    Coarse is the own value above the unit depth, else the mean of the subtree of the ancestor one level above it.
    """
    o = table(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("gt")).withColumn("depth", depth_of(F.col("id")))
    up = lambda d: F.expr(f"CAST(shiftright(id + 1, depth - {d}) - 1 AS BIGINT)")
    t = t.withColumn("parent", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)).cast("long"))
    t = t.withColumn("unit", F.when(F.col("depth") >= unit_depth, up(unit_depth))).withColumn("top", F.when(F.col("depth") >= unit_depth - 1, up(unit_depth - 1)))
    mean = t.where("top IS NOT NULL").groupBy("top").agg(F.avg("gt").alias("mean"))
    t = t.join(F.broadcast(mean), "top", "left")  # one row for each node of the level above the unit depth
    return t.withColumn("coarse", F.when(F.col("depth") < unit_depth, F.col("gt")).otherwise(F.col("mean"))).select("id", "parent", "depth", "unit", "gt", "coarse")


def knn_edges(points: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """(src, dst, dist) of the k nearest other points in the plane, ties by id.

    Points meet in a square cell and its eight neighbours only; a point is done when its
    k-th distance is no more than the way to the border of that block. The rest go on
    with cells of twice the size, so every pass is an equi-join. The first cell has k
    points on average; where the fullest one has over 16 times as many, smaller cells are
    taken, so that clustered points find their neighbours before the cells grow.
    """
    spark = points.sparkSession
    p = points.select("id", "x", "y")
    lim = p.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.count("*").alias("n")).first()
    if not lim["n"]:
        return spark.createDataFrame([], "src long, dst long, dist double")
    span = max(lim["b"] - lim["a"], lim["d"] - lim["c"], 1e-9)
    cell = cell or span * (max(k, 1) / max(lim["n"], 1)) ** 0.5
    while cell > span * 2**-24:
        full = p.groupBy(F.floor(F.col("x") / F.lit(cell)), F.floor(F.col("y") / F.lit(cell))).agg(F.count("*").alias("n")).agg(F.max("n").alias("m")).first()["m"]
        if full <= 16 * max(k, 1):
            break
        cell /= max(2.0, (full / (8 * max(k, 1))) ** 0.5)
    todo, out = p, None
    ring = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    while True:
        bx, by = (F.floor(F.col(c) / F.lit(cell)) for c in ("x", "y"))
        a = todo.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), bx.alias("gx"), by.alias("gy"))
        a = a.withColumn("o", F.explode(F.array(*ring))).withColumns({"bx": F.col("gx") + F.col("o.i"), "by": F.col("gy") + F.col("o.j")})
        b = p.select(F.col("id").alias("dst"), "x", "y", bx.alias("bx"), by.alias("by"))
        d = F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2)
        m = a.join(b, ["bx", "by"]).where("src <> dst").withColumn("dist", d)
        m = m.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("rk") <= k)
        edge = F.least(F.col("ax") - (F.col("gx") - 1) * cell, (F.col("gx") + 2) * cell - F.col("ax"), F.col("ay") - (F.col("gy") - 1) * cell, (F.col("gy") + 2) * cell - F.col("ay"))
        last = cell > span
        m = m.withColumn("edge", edge)
        whole = m.groupBy("src").agg(F.count("*").alias("c"), F.max("dist").alias("far"), F.min("edge").alias("edge"))
        done = whole if last else whole.where((F.col("c") == k) & (F.col("far") <= F.col("edge")))
        got = m.join(done.select("src"), "src", "left_semi").select("src", "dst", "dist")
        out = got if out is None else out.unionByName(got)
        if last:
            return out
        todo = todo.join(done.select(F.col("src").alias("id")), "id", "left_anti").checkpoint()
        if todo.isEmpty():
            return out
        cell *= 2


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, dist) of all pairs a < b within the radius: cells of that size meet their neighbours only, each by one of the two."""
    bx, by = (F.floor(F.col(c) / F.lit(radius)) for c in ("x", "y"))
    ring = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) >= (0, 0)]
    a = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), bx.alias("gx"), by.alias("gy"))
    a = a.withColumn("o", F.explode(F.array(*ring))).withColumns({"bx": F.col("gx") + F.col("o.i"), "by": F.col("gy") + F.col("o.j")})
    b = points.select(F.col("id").alias("b"), "x", "y", bx.alias("bx"), by.alias("by"))
    d = F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2)
    m = a.join(b, ["bx", "by"]).where("a < b OR a > b AND (gx <> bx OR gy <> by)").withColumn("dist", d).where(F.col("dist") <= radius)
    return m.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")


def lattice_edges(spark: SparkSession, side: int) -> DataFrame:
    """Undirected 4-neighbour edges (src < dst) of a square lattice."""
    n = spark.range(side * side)
    right = n.where(F.col("id") % side < side - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = n.where(F.col("id") < side * (side - 1)).select(F.col("id").alias("src"), (F.col("id") + side).alias("dst"))
    return right.unionAll(down)


def with_morton(cells: DataFrame, row: str = "ti", col: str = "tj") -> DataFrame:
    return cells.withColumn("morton", morton(F.col(row), F.col(col)))
