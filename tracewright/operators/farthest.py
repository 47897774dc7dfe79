"""The two points of a table on the sphere that are farthest apart, without comparing all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators.storage import kept

RADIUS_KM = 6371.0
#: Degrees of the first cells; each further level halves them. At the last one a cell is below a millimetre.
FIRST_DEGREES, LEVELS = 30.0, 32
#: Cells are cut while the points of the pairs that are left give more pairs than so many per point, and more than LEAST_PAIRS.
PAIRS_PER_POINT, LEAST_PAIRS = 8, 1_000_000
#: Kilometres that rounding may cost a bound.
SLACK = 1e-3


def _km(haversine: Column) -> Column:
    """Of opposite points rounding may leave no number; they are half the circumference apart."""
    return F.nanvl(scalars.arc_km(haversine), F.lit(math.pi * RADIUS_KM))


def _between(*names: str) -> Column:
    return scalars.haversine(*map(F.col, names))


def _cell(degrees: float) -> list[Column]:
    """Of a point the band of latitude and the column of longitude."""
    return [F.floor((F.col("lat") + 90) / degrees).cast("long").alias("band"), F.floor((F.col("lon") + 180) / degrees).cast("long").alias("column")]


def _cells(points: DataFrame, degrees: float) -> DataFrame:
    """band, column, n, mid_lat, mid_lon, reach (no point of the cell is farther from its middle, in km), one (a point of it).

    From the middle one gets to any point along the meridian and then along its parallel."""
    of = points.groupBy(*_cell(degrees)).agg(F.count("*").alias("n"), F.min(F.struct("lat", "lon")).alias("one"))
    low = F.col("band") * degrees - 90
    widest = F.when((low <= 0) & (low + degrees >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(low), F.abs(low + degrees)))))
    reach = (degrees / 2 + degrees / 2 * widest) * (math.pi / 180 * RADIUS_KM)
    return of.select("band", "column", "n", (low + degrees / 2).alias("mid_lat"), (F.col("column") * degrees - 180 + degrees / 2).alias("mid_lon"), reach.alias("reach"), "one")


def _side(cells: DataFrame, side: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(f"{c}_{side}") for c in cells.columns])


def _bounded(pairs: DataFrame) -> DataFrame:
    """Adds most, which no two points of the cells exceed, and least, the distance of two of their points."""
    middle, ones = _km(_between("mid_lat_a", "mid_lon_a", "mid_lat_b", "mid_lon_b")), _km(_between("one_a.lat", "one_a.lon", "one_b.lat", "one_b.lon"))
    return pairs.withColumns({"most": middle + F.col("reach_a") + F.col("reach_b"), "least": ones})


def farthest(rows: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """One row: a, b (a <= b), km, n_points, n_compared: the pair of points that is farthest apart, by the great circle.

    Points lie in cells of latitude and longitude. Two cells bound the distance of their points from above by that of their middles and
    both reaches, and any two points in them bound the answer from below: pairs of cells that cannot reach the best of those are
    dropped, those left are cut into smaller cells, and exact distances are taken only of points whose cells stay together to the end.
    n_compared counts those; the pairs of the first cells are at most 84 squared. Points in one place count once, with their least key.
    Pairs rank by the haversine of their coordinates, of which kilometres round some to the same number; of equal haversines the pair
    with the least keys is given. Rows with a null place or key, or a latitude beyond 90 degrees, are no points; longitudes are taken
    modulo 360, those from -180 to under 180 as they are. One point makes a pair with itself at 0 km, none makes no row."""
    place = rows.where((F.abs(lat) <= 90) & F.col(lon).isNotNull() & F.col(key).isNotNull())
    given = F.col(lon).cast("double")
    east = given + 180
    turned = F.when((east >= 0) & (east < 360), given).otherwise(F.pmod(east, F.lit(360.0)) - 180)
    place = place.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), turned.alias("lon"))
    points = kept(place.groupBy("lat", "lon").agg(F.min("key").alias("key")))
    n_points, degrees, best, pairs = points.count(), FIRST_DEGREES, 0.0, None
    n_compared = 0
    for _ in range(LEVELS):
        if pairs is not None:
            sides = pairs.select(F.inline(F.array(F.struct(F.col("band_a").alias("band"), F.col("column_a").alias("column")), F.struct(F.col("band_b").alias("band"), F.col("column_b").alias("column"))))).distinct()
            points = kept(points.select("*", *_cell(2 * degrees)).join(sides, ["band", "column"], "left_semi").select("key", "lat", "lon"))
        cells = kept(_cells(points, degrees))
        a, b = _side(cells, "a"), _side(cells, "b")
        if pairs is None:
            met = a.join(F.broadcast(b), F.struct("band_a", "column_a") <= F.struct("band_b", "column_b"))  # 84 cells
        else:
            half = lambda c: F.floor(F.col(c) / 2).cast("long")
            parents = pairs.select(*[F.col(c).alias(f"__{c}") for c in ("band_a", "column_a", "band_b", "column_b")])
            for side, cut in (("a", a), ("b", b)):
                own = cut.withColumns({f"__band_{side}": half(f"band_{side}"), f"__column_{side}": half(f"column_{side}")})
                parents = parents.join(own, [f"__band_{side}", f"__column_{side}"])
            apart = (F.col("__band_a") != F.col("__band_b")) | (F.col("__column_a") != F.col("__column_b"))
            met = parents.where(apart | (F.struct("band_a", "column_a") <= F.struct("band_b", "column_b")))
        met = kept(_bounded(met))
        best = max(best, met.agg(F.max("least")).first()[0] or 0.0)
        pairs = kept(met.where(F.col("most") + SLACK >= best).select("band_a", "column_a", "band_b", "column_b", "n_a", "n_b"))
        n_compared = pairs.agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
        if n_compared <= max(LEAST_PAIRS, PAIRS_PER_POINT * n_points):
            break
        degrees /= 2
    own = points.select("*", *_cell(degrees))
    side = lambda s: own.select(*[F.col(c).alias(f"{c}_{s}") for c in ("band", "column", "key", "lat", "lon")])
    both = pairs.join(side("a"), ["band_a", "column_a"]).join(side("b"), ["band_b", "column_b"])
    x = _between("lat_a", "lon_a", "lat_b", "lon_b")
    each = both.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), F.when(F.col("key_a") == F.col("key_b"), 0.0).otherwise(x).alias("x"))
    return each.orderBy(F.col("x").desc(), "a", "b").limit(1).select("a", "b", _km(F.col("x")).alias("km"), F.lit(n_points).cast("long").alias("n_points"), F.lit(n_compared).cast("long").alias("n_compared"))
