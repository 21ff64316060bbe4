"""Tables that are computed once for a state of their source files and read again by later queries.

A stored table lies under the shared checkpoint folder, named by what it is and by a hash of its source's files (path, size and time of
change), so a changed source has another table. Writing is idempotent: a folder counts when Spark has marked it as whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.shared import checkpoint_dir


def fingerprint(source: DataFrame) -> str:
    """Of the files that source reads; their names, sizes and times alone are read."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("x")).first()
    return f"{row.n}-{(row.x or 0) & (2**64 - 1):016x}"


def stored(name: str, source: DataFrame | list[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` over source (or several), built by build() if it is not there yet. The name says the version of what build()
    writes: tables of older code are not read."""
    sources = source if isinstance(source, list) else [source]
    spark = sources[0].sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored/{name}-{'-'.join(map(fingerprint, sources))}"
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
