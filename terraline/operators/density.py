"""Spatial thinning, densities, ranks, suppression and candidate scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraline.functions import geo
from terraline.session import written

#: Weights of place categories, those that count as commercial, and the score's thresholds.
POI_WEIGHTS = {
    "commercial.supermarket": 1.00, "commercial.shopping_mall": 1.00, "commercial.marketplace": 0.95, "service.financial.bank": 1.00, "accommodation.hotel": 0.85, "catering.restaurant": 0.70,
    "catering.cafe": 0.55, "commercial": 0.60, "office.government": 0.55, "office": 0.45, "education.school": 0.45, "healthcare": 0.40,
}
COMMERCIAL = ("commercial", "catering", "accommodation")
CONFIDENCE = {"HIGH": (0.60, 0.70), "MEDIUM": (0.40, 0.40)}


#: Kilometres of a thinning cell and a degree, and of the least spacing of candidates.
CELL_KM, KM_PER_DEGREE, SPACING_KM = 0.15, 111.0, 0.30


def thinned(nodes: DataFrame, cell_km: float = CELL_KM, most: int | None = 600) -> DataFrame:
    """The node of the highest closeness in each cell, ties to the smaller id, then the ``most`` best. Cells truncate
    towards zero and don't shorten with the latitude."""
    cell = lambda c: F.expr(f"cast({c} / {cell_km / KM_PER_DEGREE!r}D as bigint)")
    best = nodes.groupBy(cell("lat").alias("cy"), cell("lon").alias("cx")).agg(F.max_by(F.struct("id", "lat", "lon", "closeness"), F.struct(F.col("closeness"), -F.col("id"))).alias("b")).select("cy", "cx", "b.*")
    return best.orderBy(F.desc("closeness"), "id").limit(most) if most else best


def densities(candidates: DataFrame, points: DataFrame, radii_km: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """(id, n_0, n_1, ...): points within each radius of each candidate, itself included. Points and candidates that share
    a place are one row with a count, so crowded places cost one distance. Places go to cells of bands of latitude, which
    are as wide as the largest radius at any latitude, and asked places to the cells around them, across the date line
    too: the join hashes by cell and only near places meet."""
    size = max(radii_km)
    reach = math.degrees(size * 1000 / geo.EARTH_M) * (1 + 1e-9)
    band = F.floor(F.col("lat") / reach)

    def cells_in(b: Column) -> Column:
        """Cells of a band: as many as are no narrower than the radius at the band's edge that is nearer to a pole."""
        edge = F.least(F.lit(90.0), F.greatest(F.abs(b * reach), F.abs((b + 1) * reach)))
        return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / reach))

    at = F.pmod(F.col("lon"), F.lit(360.0))
    held = points.groupBy("lat", "lon").agg(F.count("*").alias("n")).withColumn("cy", band)
    held = held.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "n", "cy", F.floor(at * cells_in(F.col("cy")) / 360.0).alias("cx"))
    across = geo.degrees_of_longitude(F.col("lat"), size)
    asked = candidates.select("lat", "lon").distinct().withColumn("cy", F.explode(F.sequence(band - 1, band + 1))).withColumn("cells", cells_in(F.col("cy")))
    first, last = F.floor((at - across) * F.col("cells") / 360.0), F.floor((at + across) * F.col("cells") / 360.0)
    asked = asked.withColumn("cx", F.explode(F.sequence(first, F.least(last, first + F.col("cells") - 1)))).select("lat", "lon", "cy", F.pmod("cx", "cells").alias("cx"))
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    found = asked.join(held, ["cy", "cx"]).withColumn("d", d).where(F.col("d") <= size)
    counts = found.groupBy("lat", "lon").agg(*[F.sum(F.when(F.col("d") <= r, F.col("n")).otherwise(0)).alias(f"n_{k}") for k, r in enumerate(radii_km)])
    return candidates.select("id", "lat", "lon").join(counts, ["lat", "lon"], "left").select("id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in range(len(radii_km))])


def ordinal_percentile(df: DataFrame, value: str, tie: str, out: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Place over places minus one, equal values in the order of ``tie``; 1 for a single row.

    Rows are dealt into ranges of group, value and tie, as many as the session has shuffle partitions; a row's place is its
    place in its range plus the rows of its group in the ranges before, so no task holds a whole group. The ranges are
    written once, since their bounds are drawn from a sample."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(ranges, *by, value, tie).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    renamed = counts.withColumnsRenamed({"_range": "_r"} | {c: f"_by_{c}" for c in by})
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *by).orderBy(value, tie)))
    found = placed.join(renamed, same)
    share = (F.col("_place") + F.col("_before") - 1) / F.greatest(F.col("_all") - 1, F.lit(1))
    return found.withColumn(out, F.when(F.col("_all") == 1, F.lit(1.0)).otherwise(share)).select(*[c for c in df.columns if c != out], out)


def stability(columns: list[str]) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (F.greatest(*columns) - F.least(*columns))))


def suppressed(candidates: DataFrame, spacing_km: float = SPACING_KM, most: int = 12, by: str = "pool") -> DataFrame:
    """Greedy: from the best score on (ties to the smaller id), keep what is at least ``spacing_km`` from all kept, up
    to ``most`` in each pool. A pool is what thinning has left, hundreds of rows, and each is one group."""
    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.EARTH_M / 1000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    def keep(pool: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        places: list[tuple[float, float]] = []
        ordered = pool.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        for i, here in enumerate(zip(ordered.lat, ordered.lon)):
            if len(kept) == most:
                break
            if all(km(here, p) >= spacing_km for p in places):
                kept.append(i)
                places.append(here)
        return ordered.loc[kept]

    return candidates.groupBy(by).applyInPandas(keep, candidates.schema)


def poi_evidence(places: DataFrame, saturation: float = 15.0) -> DataFrame:
    """(candidate_id, economic_activity, commercial_density, land_use, poi_count, data_coverage) from places
    (candidate_id, categories); a null array marks a failed fetch, which is no evidence rather than evidence of none."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in POI_WEIGHTS.items() for x in kv])[F.col("category")], F.lit(0.0))
    commercial = F.col("category").rlike("^(" + "|".join(COMMERCIAL) + ")")
    each = places.withColumn("_place", F.monotonically_increasing_id()).select("candidate_id", "_place", F.col("categories").isNotNull().alias("known"), F.explode_outer("categories").alias("category"))
    by_place = each.groupBy("candidate_id", "_place").agg(F.max("known").alias("known"), F.coalesce(F.max(weight), F.lit(0.0)).alias("w"), F.coalesce(F.max(commercial), F.lit(False)).alias("c"), F.collect_set(F.when(commercial, F.substring_index("category", ".", 1))).alias("tops"))
    total = by_place.groupBy("candidate_id").agg(F.count_if("known").alias("n"), F.sum("w").alias("w"), F.count_if("c").alias("c"), F.size(F.array_distinct(F.flatten(F.collect_set("tops")))).alias("kinds"))
    has = F.col("n") > 0
    return total.select("candidate_id", F.when(has, F.least(F.lit(1.0), F.col("w") / saturation)).otherwise(0.0).alias("economic_activity"), F.when(has, F.least(F.lit(1.0), F.try_divide("c", "n") * 1.3)).otherwise(0.0).alias("commercial_density"), F.when(has, F.least(F.lit(1.0), F.col("kinds") / 6.0)).otherwise(0.0).alias("land_use"), F.col("n").alias("poi_count"), has.cast("double").alias("data_coverage"))


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    """Negative weights count as 0; all 0 become equal."""
    clean = {k: max(0.0, w) for k, w in weights.items()}
    total = sum(clean.values())
    return {k: w / total if total > 0 else 1 / len(clean) for k, w in clean.items()}


def cbd_score(weights: dict[str, float]) -> Column:
    w = normalised_weights(weights)
    out = F.lit(0.0)
    for k, v in w.items():
        out = out + F.lit(v) * F.col(k)
    return out


def confidence(score: Column, stable: Column, coverage: Column) -> Column:
    out = F.when(coverage <= 0, "LOW")
    for name, (s, t) in CONFIDENCE.items():
        out = out.when((score >= s) & (stable >= t), name)
    return out.otherwise("LOW")


#: How far a planned place reaches, and its most.
BOOST_KM, BOOST = 1.5, 0.25


def future_boost(distance_km: Column, radius_km: float = BOOST_KM, most: float = BOOST) -> Column:
    return most * F.greatest(F.lit(0.0), 1 - distance_km / radius_km)


def primary_and_secondary(validated: DataFrame, apart_km: float = SPACING_KM, most: int = 5) -> DataFrame:
    """The best candidate (ties to the smaller id) as primary and the next ones farther than ``apart_km`` as secondary."""
    top = validated.orderBy(F.desc("cbd_score"), "id").limit(1).select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    far = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    ranked = validated.join(F.broadcast(top)).withColumn("role", F.when(F.col("id") == F.col("_id"), "primary").when(far > apart_km, "secondary")).where("role is not null").drop("_id", "_lat", "_lon")
    return ranked.orderBy("role", F.desc("cbd_score"), "id").limit(most + 1)
