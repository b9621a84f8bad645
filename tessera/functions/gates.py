"""Decisions as Column expressions; the numbers are the thresholds of the method."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone(version: int, curvature: Column, gini: Column, third: Column | None = None) -> Column:
    """GREEN for positive mean curvature, YELLOW for even hubs (and, from version 2, low spread or entropy), else RED."""
    yellow = gini < 0.12
    if version == 2:
        yellow = yellow & (third <= 1.5)
    elif version == 3:
        yellow = yellow & (third <= 0.70)
    return F.when(curvature > 0, "GREEN").when(yellow, "YELLOW").otherwise("RED")


def zone_correct(zone_: Column, cut: Column, clusters: Column) -> Column:
    return (
        F.when(zone_ == "GREEN", cut < 0.05)
        .when(zone_ == "YELLOW", (cut >= 0.05) & (cut <= 0.30))
        .otherwise((cut > 0.30) | (clusters <= 1))
    )


def should_compress(active: Column, budget: Column, stable: Column, critical: int = 12) -> Column:
    return F.when(budget >= 0.5 * active, "bombardment_density").when(stable < critical, "below_n_critical").otherwise("viable")


def cv_threshold(space: Column, budget: Column) -> Column:
    return F.when((space == "irregular_graph") & (budget == "high"), 0.25).otherwise(0.10)


def two_stage(fsr: Column, instability: Column, fsr_max: float, instability_max: float) -> Column:
    """1 where healthy, else the quality that is left, 0.2 at least."""
    ok = (fsr <= fsr_max) & (instability <= instability_max)
    return F.when(ok, F.lit(1.0)).otherwise(F.greatest(F.lit(0.2), 1 - 0.3 * (2 * fsr + instability)))


def layout(space: Column, heavy: Column, density: Column, spatial: Column, cut: Column, waste: Column) -> Column:
    """Physical layout by space, weight of the operator, density, and for graphs cross-block ratio and padding waste."""
    return (
        F.when(space.isin("scalar_grid", "vector_grid"), "direct")
        .when((space == "tree_hierarchy") & heavy & (density < 0.40), "direct")
        .when((space == "irregular_graph") & spatial & (cut <= 0.35) & (waste < 0.50), "blocked")
        .otherwise("bitset")
    )
