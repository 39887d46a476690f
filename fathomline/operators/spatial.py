"""Distances, point-in-polygon joins on a grid and nearest-vertex search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import checkpoints

EARTH_KM = 6371.0


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.radians(F.col(x) if isinstance(x, str) else x) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_rings(x: str, y: str, rings: str) -> Column:
    """Even-odd ray casting over all rings (array of rings, a ring an array of (x, y) structs).

    Holes are further rings. Points on an edge may count either way.
    """
    return F.expr(
        f"aggregate({rings}, 0, (n, r) -> n + aggregate(sequence(1, greatest(size(r), 1)), 0, (m, i) -> m + "
        f"if((r[i - 1].y > {y}) <> (r[i % size(r)].y > {y}) AND {x} < r[i - 1].x + ({y} - r[i - 1].y) * "
        f"(r[i % size(r)].x - r[i - 1].x) / nullif(r[i % size(r)].y - r[i - 1].y, 0.0D), 1, 0))) % 2 = 1"
    )


def polygon_join(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str = "rings", cell: float = 1.0) -> DataFrame:
    """Points with the polygons that hold them: a grid cell is the join key, then box, then ray cast.

    A place and a shape are tested on one another once, however many points and polygons have them; what is left to do for these is the output.
    """
    bounds = polygons.select(rings).distinct().withColumn("__all", F.flatten(rings)).select(
        rings,
        *(F.expr(f"array_{f}(transform(__all, p -> p.{c}))").alias(f"__{c}{k}") for c in "xy" for k, f in ((0, "min"), (1, "max"))),
    )
    cells = bounds.withColumn("__cx", F.explode(F.expr(f"sequence(CAST(floor(__x0 / {cell}) AS BIGINT), CAST(floor(__x1 / {cell}) AS BIGINT))")))
    cells = cells.withColumn("__cy", F.explode(F.expr(f"sequence(CAST(floor(__y0 / {cell}) AS BIGINT), CAST(floor(__y1 / {cell}) AS BIGINT))")))
    keyed = points.select(x, y).distinct().withColumn("__px", F.floor(F.col(x) / cell)).withColumn("__py", F.floor(F.col(y) / cell))
    near = keyed.join(cells, (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")))
    inside = F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1")) & in_rings(x, y, rings)
    met = near.where(inside).select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(rings).alias("__rings"))
    held = points.join(met, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y"))).drop("__x", "__y")
    return held.join(polygons, F.col("__rings") == F.col(rings)).select(*points.columns, *(c for c in polygons.columns if c != rings))


def nearest(points: DataFrame, targets: DataFrame, point: str, reaches: tuple[int, ...] = (3, 12, 45, 180)) -> DataFrame:
    """(point, target, km): the nearest of all targets; ties go to the smaller id.

    Points look at their own and the neighbouring cells of latitude and longitude, across 180 degrees too. Cells grow (their
    degrees divide 360) only for points to which a target further away could be nearer, which are written down in between; the last cells
    hold every target. Points without a place are left out, as targets are. A place is looked up once however many points or
    targets it has; of a place's targets the smallest id counts.
    """
    checkpoints(points.sparkSession)
    asked = points.select(F.col(point), F.col("lat").cast("double").alias("__lat"), F.col("lng").cast("double").alias("__lng")).where("__lat IS NOT NULL AND __lng IS NOT NULL").distinct()
    left = asked.select("__lat", "__lng").distinct()
    given = targets.select("target", F.col("lat").cast("double").alias("__tlat"), F.col("lng").cast("double").alias("__tlng")).where("__tlat IS NOT NULL AND __tlng IS NOT NULL")
    given = given.groupBy("__tlat", "__tlng").agg(F.min("target").alias("target"))
    km = haversine_km("__lat", "__lng", "__tlat", "__tlng")
    keep, done = ["__lat", "__lng"], None
    for reach in reaches:
        row, turn = "CAST(floor({} / " + str(reach) + ") AS INT)", 360 // reach
        near = f"transform(sequence(-1, 1), j -> struct({row.format('__lat')} + i AS a, pmod({row.format('__lng')} + j, {turn}) AS b))"
        around = F.explode(F.expr(f"array_distinct(flatten(transform(sequence(-1, 1), i -> {near})))"))
        t = given.withColumn("__cell", F.expr(f"struct({row.format('__tlat')} AS a, pmod({row.format('__tlng')}, {turn}) AS b)"))
        met = left.withColumn("__cell", around).join(t, "__cell", "left").withColumn("km", km)
        best = met.groupBy(*keep).agg(F.min(F.when(F.col("km").isNotNull(), F.struct("km", "target"))).alias("b")).checkpoint()
        if reach < reaches[-1]:
            # no target in other cells is nearer than the meridian or the parallel so many degrees away
            wide = F.lit(EARTH_KM) * F.asin(F.cos(F.radians("__lat")) * F.sin(F.radians(F.lit(float(min(reach, 90))))))
            sure = F.least(wide, F.lit(EARTH_KM) * F.radians(F.lit(float(reach))))
            settled = F.coalesce(F.col("b.km") < sure - 1e-6, F.lit(False))
            left = best.where(~settled).select(*keep)
            best = best.where(settled)
        best = best.select(*keep, "b.target", "b.km")
        done = best if done is None else done.unionAll(best)
        if reach < reaches[-1] and not left.limit(1).count():
            break
    return asked.join(done, keep).select(point, "target", "km")


nearest_of_all = nearest


def farthest_points(points: DataFrame, key: str, x: str, y: str, k: int) -> DataFrame:
    """(key, turn): k points, each the farthest from those before it; the first is the smallest key, as are ties.

    Every turn is one pass over the points, which are written down with their distance from the chosen ones; only the chosen point
    reaches the driver.
    """
    spark = points.sparkSession
    checkpoints(spark)
    at = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(float("inf")).alias("gap")).where("x IS NOT NULL AND y IS NOT NULL").checkpoint()
    chosen: list[tuple] = []
    while len(chosen) < k:
        top = at.agg(F.min(F.struct((-F.col("gap")).alias("g"), F.col(key).alias("k"), "x", "y")).alias("b")).first().b
        if top is None or top.g >= 0:
            break
        chosen.append((top.k, top.x, top.y))
        if len(chosen) < k:
            gap = F.pow(F.col("x") - top.x, 2) + F.pow(F.col("y") - top.y, 2)
            at = at.withColumn("gap", F.least("gap", gap)).checkpoint()
    kind = dict(points.dtypes)[key]
    return spark.createDataFrame([(c[0], i) for i, c in enumerate(chosen)], f"{key} {kind}, turn int")


def crosses_antimeridian(ring: str) -> Column:
    """Whether two neighbouring vertices lie over 180 degrees of longitude apart."""
    return F.expr(f"exists(sequence(1, greatest(size({ring}) - 1, 1)), i -> i < size({ring}) AND abs({ring}[i].x - {ring}[i - 1].x) > 180)")


def distinct_points(df: DataFrame, name: str, lat: str, lng: str, digits: int = 4) -> DataFrame:
    """One row per (lower-cased name, rounded place)."""
    keyed = df.withColumn("__n", F.lower(name)).withColumn("__a", F.round(lat, digits)).withColumn("__b", F.round(lng, digits))
    return keyed.dropDuplicates(["__n", "__a", "__b"]).drop("__n", "__a", "__b")
