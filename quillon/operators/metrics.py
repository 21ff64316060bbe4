"""Counter rates and histogram quantiles over metric samples, as a time-series engine computes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 6
NUDGE = 1e-10  # sums that end in a 5 behind the last digit round alike in any order


def increases(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Adds inc: growth of a counter since the series' last sample; a fall is a reset, and counts as the new value. Samples of one time go by value."""
    order = Window.partitionBy(*keys).orderBy("ts", "value")
    last = F.lag("value").over(order)
    return samples.withColumn("inc", F.when(last.isNull(), 0.0).when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last))


def rate(samples: DataFrame, keys: list[str], by: list[str], window: str) -> DataFrame:
    """sum by (by) (rate(counter[window])): increase a second in each window."""
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    rows = increases(samples, keys).groupBy(*by, F.window("ts", window).alias("w")).agg(F.sum("inc").alias("inc"))
    return rows.select(*by, F.col("w.start").alias("start"), F.round(F.col("inc") / seconds + NUDGE, DIGITS).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """The q-quantile of cumulative buckets (le, count), by linear interpolation in its bucket; the last finite bound beyond."""
    series = Window.partitionBy(*by)
    order = series.orderBy("le")
    rows = buckets.withColumn("total", F.max("count").over(series)).withColumn("below", F.coalesce(F.lag("count").over(order), F.lit(0.0))).withColumn("from", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
    wanted = F.lit(q) * F.col("total")
    infinite = F.col("le") == F.lit(float("inf"))
    value = F.when(infinite, F.col("from")).otherwise(F.col("from") + (F.col("le") - F.col("from")) * F.coalesce(F.try_divide(wanted - F.col("below"), F.col("count") - F.col("below")), F.lit(0.0)))
    hit = rows.where((F.col("count") >= wanted) & (F.col("total") > 0)).withColumn("value", value)
    return hit.groupBy(*by).agg(F.round(F.min_by("value", "le"), DIGITS).alias("quantile"))
