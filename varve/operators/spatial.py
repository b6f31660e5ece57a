"""Projection of coordinates onto a transect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transect(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """x_km and y_km around the mean point, and the position along their principal axis, eastward.

    The axis is the leading eigenvector of a 2 x 2 scatter, in closed form, so
    two small aggregates are all that is exchanged.
    """
    mean = df.agg(F.avg(lat).alias("__a"), F.avg(lon).alias("__o"))
    xy = df.crossJoin(F.broadcast(mean)).withColumns(
        {"x_km": (F.col(lon) - F.col("__o")) * 111.320 * F.cos(F.radians("__a")), "y_km": (F.col(lat) - F.col("__a")) * 110.574}
    ).drop("__a", "__o")
    x, y = F.col("x_km"), F.col("y_km")
    axis = xy.agg((F.lit(0.5) * F.atan2(2 * F.sum(x * y), F.sum(x * x) - F.sum(y * y))).alias("__t"))
    t = F.col("__t")
    along = (x * F.cos(t) + y * F.sin(t)) * F.signum(F.cos(t))
    return xy.crossJoin(F.broadcast(axis)).withColumn("transect_km", along).drop("__t")
