"""Layouts as tables: active tiles packed into slots, neighbour tables, stencils, bitsets, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tile_map(cells: DataFrame, active: str = "active") -> DataFrame:
    """(unit, ti, tj, slot): tiles with any active cell, numbered by unit; -1 for the others."""
    t = cells.groupBy("unit", "ti", "tj").agg(F.bool_or(active).alias("on"))
    slot = F.row_number().over(Window.partitionBy("on").orderBy("unit")) - 1
    return t.withColumn("slot", F.when(F.col("on"), slot).otherwise(-1)).drop("on")


def neighbour_table(tiles: DataFrame) -> DataFrame:
    """(unit, di, dj, slot): for each active tile and each of nine offsets the neighbour's slot, -1 where there is none."""
    ring = [F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    a = tiles.where("slot >= 0").select("unit", "ti", "tj", F.explode(F.array(*ring)).alias("o"))
    a = a.select("unit", "o.di", "o.dj", (F.col("ti") + F.col("o.di")).alias("ti"), (F.col("tj") + F.col("o.dj")).alias("tj"))
    return a.join(tiles.select("ti", "tj", "slot"), ["ti", "tj"], "left").select("unit", "di", "dj", F.coalesce("slot", F.lit(-1)).alias("slot"))


def stencil(cells: DataFrame, weights: list[list[float]], value: str = "gt", within: str | None = None, active: str | None = None) -> DataFrame:
    """(r, c, v): 3 x 3 stencil with zeros beyond the border; ``within``: cells of one tile (or channel) see each other only, and its column is kept.

    A cell gives its value, weighted, to its nine neighbours and sums meet by key: one
    shuffle that combines before it, no join.
    """
    src = cells.where(active) if active else cells
    give = [F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(float(weights[i + 1][j + 1])).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    keys = ["r", "c"] + ([within] if within else [])
    g = src.select(*keys, F.col(value).alias("v"), F.explode(F.array(*give)).alias("o"))
    g = g.select((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), *([within] if within else []), (F.col("v") * F.col("o.w")).alias("x"))
    s = g.groupBy(*keys).agg(F.sum("x").alias("v"))
    return src.select(*keys).join(s, keys, "left").select(*keys, F.coalesce("v", F.lit(0.0)).alias("v"))


def packed_bits(mask: DataFrame, index: str, active: str) -> DataFrame:
    """(word, bits, n): active flags packed 32 to a word."""
    x = mask.where(active).select(F.floor(F.col(index) / 32).alias("word"), F.expr(f"shiftleft(1L, CAST({index} % 32 AS INT))").alias("bit"))
    return x.groupBy("word").agg(F.bit_or("bit").alias("bits")).withColumn("n", F.bit_count("bits"))


def morton_blocks(nodes: DataFrame, key: str, size: int) -> DataFrame:
    """``block``: nodes cut into runs of ``size`` in order of a space-filling key, then id."""
    from .select import ranked

    r = ranked(nodes.withColumn("_n", -F.col(key)), "_n", "id")
    return r.withColumn("block", F.floor((F.col("rank") - 1) / size).cast("long")).drop("_n", "rank")


def memory_bytes(side: int, active: int, cell: int = 4, tile: int = 8, tiles: int | None = None) -> dict[str, int]:
    """Bytes of the layouts of a grid: full grid with bitset, compact list with reverse map, packed tiles with tile map."""
    n = side * side
    t = tiles if tiles is not None else -(-active // (tile * tile))
    return {"grid": n * cell + n // 8, "compact": active * (cell + 4) + n * 4, "packed": t * tile * tile * cell + (side // tile) ** 2 * 4}


def hash_table(keys: DataFrame, key: str, bits: int, ranges: int = 64) -> DataFrame:
    """(key, home, place): open addressing with linear probing over 2**bits homes, keys placed in order of home, then key.

    In that order each key's place is its number plus the largest home less number so far:
    a running maximum, taken in ranges of homes and joined by one row a range. Places
    beyond the last home form a tail, so nothing wraps round. A lookup goes on from the
    home until it meets the key or an empty place.
    """
    from ..functions.scalar import hash_keys

    x = keys.select(F.col(key).cast("long").alias("key")).distinct().withColumn("home", hash_keys(F.col("key"), 32 - bits).cast("long"))
    x = x.withColumn("_b", F.floor(F.col("home") * ranges / F.lit(1 << bits)))
    w = Window.partitionBy("_b").orderBy("home", "key")
    x = x.withColumn("_i", F.row_number().over(w) - 1)
    x = x.withColumn("_m", F.max(F.col("home") - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    g = x.groupBy("_b").agg(F.count("*").alias("_n"), F.max("_m").alias("_top")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    g = g.withColumn("_prev", F.max(F.col("_top") - F.col("_at")).over(before)).select("_b", "_at", "_prev")
    y = x.join(F.broadcast(g), "_b")  # one row a range
    place = F.col("_at") + F.col("_i") + F.greatest(F.col("_m") - F.col("_at"), F.col("_prev"))
    return y.select("key", "home", place.cast("long").alias("place"))


def pages(cells: DataFrame, size: int, active: str = "active") -> DataFrame:
    """(py, px, slot, n, mask): pages of size x size cells with any active cell, numbered in row order; bits of ``mask`` are active cells (8 x 8 at most)."""
    if size > 8:
        raise ValueError("a page's mask has 64 bits")
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    bit = F.expr(f"shiftleft(1L, CAST((r % {size}) * {size} + c % {size} AS INT))")
    p = cells.where(active).groupBy(at("r").alias("py"), at("c").alias("px")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("mask"))
    row = p.groupBy("py").agg(F.count("*").alias("_k")).withColumn("_at", F.coalesce(F.sum("_k").over(Window.orderBy("py").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.join(row.select("py", "_at"), "py")
    return p.select("py", "px", (F.row_number().over(Window.partitionBy("py").orderBy("px")) - 1 + F.col("_at")).alias("slot"), "n", "mask")


def gather_halo(cells: DataFrame, tiles: DataFrame, tile: int, halo: int, value: str = "gt") -> DataFrame:
    """(unit, i, j, v): each active tile with its halo, cells of inactive tiles and beyond the border as 0. ``tiles``: unit, ti, tj, slot."""
    a = tiles.where("slot >= 0")
    span = F.sequence(F.lit(0), F.lit(tile + 2 * halo - 1))
    want = a.select("unit", "ti", "tj", F.explode(span).alias("i")).withColumn("j", F.explode(span))
    want = want.select("unit", "i", "j", (F.col("ti") * tile + F.col("i") - halo).alias("r"), (F.col("tj") * tile + F.col("j") - halo).alias("c"))
    have = cells.select("r", "c", "unit", F.col(value).alias("v")).join(a.select("unit"), "unit", "left_semi").select("r", "c", "v")
    return want.join(have, ["r", "c"], "left").select("unit", "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
