"""Bid-rent models and ring reports around an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraline.functions import geo, rent


def with_distance(points: DataFrame, anchor: tuple[float, float], out: str = "d_km") -> DataFrame:
    return points.withColumn(out, geo.haversine_km(F.lit(anchor[0]), F.lit(anchor[1]), F.col("lat"), F.col("lon")))


def fit_rents(samples: DataFrame, anchor: tuple[float, float]) -> DataFrame:
    """One row (n, r0, lam, r2, d_far, status): least squares of ln(rent) on the distance over castable rents above 0.
    Fewer than 2 samples or equal distances give no model; equal rents give r2 = 1."""
    clean = with_distance(samples.select(*[F.col(c).cast("double") for c in ("lat", "lon", "rent")]).where("rent > 0 and not isnan(rent) and lat is not null and lon is not null"), anchor)
    y, x = F.log("rent"), F.col("d_km")
    sums = clean.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.max("d_km").alias("d_far"))
    ok = (F.col("n") >= 2) & (F.col("sxx") > 1e-12)
    return sums.select("n", F.when(ok, F.exp("intercept")).alias("r0"), F.when(ok, -F.col("slope")).alias("lam"), F.when(ok, F.when(F.col("syy") <= 1e-12, F.lit(1.0)).otherwise(F.col("r2"))).alias("r2"), "d_far", F.when(ok, "fitted").otherwise("too few").alias("status"))


def model(fit: DataFrame, d_max: Column | float = rent.DEFAULT_D_MAX) -> DataFrame:
    """Completes a fit: without one, an index of 100 at the anchor that falls to a quarter at ``d_max``; with one,
    d_max reaches 5 % beyond the farthest sample."""
    d = F.greatest(F.lit(rent.MIN_D_MAX), d_max if isinstance(d_max, Column) else F.lit(float(d_max)))
    index = F.col("lam").isNull()
    out = fit.withColumn("is_index", index).withColumn("d_max_km", F.when(index, d).otherwise(F.greatest(d, 1.05 * F.col("d_far"))))
    lam = F.when(index, F.log(F.lit(rent.EDGE_RATIO)) / F.col("d_max_km")).otherwise(F.col("lam"))
    return out.withColumns({"r0": F.when(index, F.lit(rent.BASE_INDEX)).otherwise(F.col("r0")), "lam": lam}).withColumns({"inverted": F.col("lam") < 0, "half_dist_km": rent.half_distance(F.col("lam"))})


def curve(models: DataFrame, points: int = rent.CURVE_POINTS) -> DataFrame:
    """(i, d_km, rent) of the model's curve."""
    at = models.select("r0", "lam", "d_max_km", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("d_km", F.col("d_max_km") * F.col("i") / (points - 1))
    return at.select("i", "d_km", rent.rent_at(F.col("d_km"), F.col("r0"), F.col("lam")).alias("rent"))


def ring_shapes(models: DataFrame, anchor: tuple[float, float]) -> DataFrame:
    """(ring, inner_km, outer_km, mid_rent, area_km2, colour, outer, inner) of the bands from the anchor outwards."""
    step = F.col("d_max_km") / rent.RINGS
    r = models.select("*", F.explode(F.sequence(F.lit(1), F.lit(rent.RINGS))).alias("ring")).withColumns({"inner_km": (F.col("ring") - 1) * step, "outer_km": F.col("ring") * step})
    mid = rent.rent_at((F.col("ring") - F.lit(0.5)) * step, F.col("r0"), F.col("lam"))
    first, last = (rent.rent_at(F.lit(k) * step, F.col("r0"), F.col("lam")) for k in (0.5, rent.RINGS - 0.5))
    low, high = F.least(first, last), F.greatest(first, last)
    norm = F.when(high > low, (mid - low) / (high - low)).otherwise(F.lit(0.0))
    lat, lon = F.lit(anchor[0]), F.lit(anchor[1])
    return r.select(
        "ring", "inner_km", "outer_km", F.round(mid, 2).alias("mid_rent"), (F.lit(3.141592653589793) * (F.col("outer_km") ** 2 - F.col("inner_km") ** 2)).alias("area_km2"), rent.ramp_colour(norm).alias("colour"),
        geo.circle(lat, lon, F.col("outer_km")).alias("outer"), F.when(F.col("inner_km") > 0, F.reverse(geo.circle(lat, lon, F.col("inner_km")))).alias("inner"),
    )


def ring_counts(points: DataFrame, step_km: float, rings: int = rent.RINGS, value: str | None = None) -> DataFrame:
    """(ring, n, mean_value, max_value) of points with d_km; ring is null outside."""
    v = F.col(value) if value else F.lit(None).cast("double")
    return points.groupBy(rent.ring_index(F.col("d_km"), F.lit(step_km), rings).alias("ring")).agg(F.count("*").alias("n"), F.avg(v).alias("mean_value"), F.max(v).alias("max_value"))


def ring_report(points: DataFrame, golden: DataFrame, samples: DataFrame, r0: float, lam: float, d_max_km: float) -> DataFrame:
    """A row for each ring and, if there are any, the points outside: share, density, mean and most of ``closeness``,
    the ranks of golden spots, the value gap and the samples. ``points``: d_km, closeness; ``golden``: d_km, rank."""
    step = d_max_km / rent.RINGS
    ring = rent.ring_index(F.col("d_km"), F.lit(step))
    spine = points.sparkSession.range(1, rent.RINGS + 1).select((F.col("id") - 1).cast("int").alias("ring"))
    counts = ring_counts(points, step, value="closeness")
    ranks = golden.groupBy(ring.alias("ring")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("rank")), lambda r: F.concat(F.lit("#"), r.cast("string"))), ", ").alias("golden"))
    sampled = samples.groupBy(ring.alias("ring")).agg(F.count("*").alias("n_samples"))
    total = points.agg(F.count("*").alias("total"))
    # the outside row is on the spine too, and goes if nothing is outside
    all_rings = spine.union(points.sparkSession.range(1).select(F.lit(None).cast("int").alias("ring")))
    out = all_rings
    for part in (counts, ranks, sampled):
        p = part.withColumnRenamed("ring", "_ring")
        out = out.join(p, F.col("ring").eqNullSafe(F.col("_ring")), "left").drop("_ring")
    out = out.join(F.broadcast(total))
    mid = F.round(rent.rent_at((F.col("ring") + F.lit(0.5)) * step, F.lit(r0), F.lit(lam)), 2)
    area = F.lit(3.141592653589793 * step * step) * (2 * F.col("ring") + 1)
    n = F.coalesce("n", F.lit(0))
    return out.where("ring is not null or n > 0").select(
        F.coalesce(F.col("ring") + 1, F.lit(0)).alias("ring"), F.when(F.col("ring").isNull(), "outside").otherwise(F.concat(F.format_number(F.col("ring") * step, 2), F.lit("-"), F.format_number((F.col("ring") + 1) * step, 2), F.lit(" km"))).alias("band"),
        area.alias("area_km2"), mid.alias("mid_rent"), n.alias("n_points"), F.try_divide(100.0 * n, F.col("total")).alias("percent"), (n / area).alias("density"),
        "mean_value", "max_value", F.coalesce("golden", F.lit("")).alias("golden"), (F.col("mean_value") - F.least(F.lit(1.0), F.greatest(F.lit(0.0), mid / F.lit(r0)))).alias("value_gap"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
    )


def first_anchor(steps: list[DataFrame]) -> DataFrame:
    """The first of one-row (lat, lon) frames, in order of preference, that has a place."""
    tagged = [s.select(F.lit(k).alias("priority"), "lat", "lon").where("lat is not null and lon is not null") for k, s in enumerate(steps)]
    all_steps = tagged[0]
    for t in tagged[1:]:
        all_steps = all_steps.union(t)
    return all_steps.agg(F.min_by(F.struct("lat", "lon"), "priority").alias("a")).select("a.lat", "a.lon")
