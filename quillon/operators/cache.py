"""Semantic result cache as a table (query, scope, vector, stored_at, response)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.vectors import DIGITS, cosine

TTL_SECONDS, DISTANCE = 3600, 0.12


def lookup(asked: DataFrame, stored: DataFrame, now: Column, ttl: int = TTL_SECONDS, distance: float = DISTANCE) -> DataFrame:
    """(query_id, response, distance): for each asked (query_id, scope, vector) the nearest live entry of its scope within distance.

    An equi-join on the scope keeps the comparison within it."""
    live = stored.where(F.col("stored_at") > now - F.make_interval(secs=F.lit(ttl)))
    pairs = asked.join(live.select("scope", "response", F.col("vector").alias("kept"), "stored_at"), "scope")
    pairs = pairs.withColumn("distance", F.round(1 - cosine(F.col("vector"), F.col("kept")), DIGITS)).where(F.col("distance") <= distance)
    nearest = Window.partitionBy("query_id").orderBy("distance", F.desc("stored_at"), "response")
    return pairs.withColumn("r", F.row_number().over(nearest)).where("r = 1").select("query_id", "response", "distance")


def put(stored: DataFrame, entry: DataFrame) -> DataFrame:
    return stored.unionByName(entry)


def hit_rate(hits: Column, misses: Column) -> Column:
    """Hits over all, to three places; null without requests."""
    return F.round(F.try_divide(hits, hits + misses), 3)
