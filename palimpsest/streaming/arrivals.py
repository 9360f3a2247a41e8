"""Paths as they arrive, read into the columns of the folder source.

A stream of paths - any source; `listed` reads lists of them that are put into a folder - becomes one
row per file, images' files included. Reading keeps no state, so the stream scales with its tasks
and a lost executor costs its part of one batch. `first_seen` keeps each content once, with the
hashes of a bounded time as its only state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.sources import folders


def listed(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of path, rel, arrived from JSON lines in files that are put into a folder."""
    return spark.readStream.schema("path string, rel string, arrived timestamp").option("maxFilesPerTrigger", per_batch).json(folder)


def read(paths: DataFrame) -> DataFrame:
    """The rows of the files at path, with the time of arrival."""
    columns = [c.split()[0] for c in folders.FILES.split(", ")]

    def go(batches):
        for pdf in batches:
            for path, rel, arrived in zip(pdf["path"], pdf["rel"], pdf["arrived"]):
                for row in folders.read_path(path, rel):
                    yield pd.DataFrame([row], columns=columns).assign(arrived=arrived)

    return paths.select("path", "rel", "arrived").mapInPandas(go, folders.FILES + ", arrived timestamp")


def first_seen(files: DataFrame, within: str = "1 day") -> DataFrame:
    """Files whose data and resource fork did not arrive before, as far back as `within`."""
    both = F.concat(*(F.coalesce(F.sha1(c), F.lit("")) for c in ("data", "rsrc")), F.lit(" "))
    return files.withColumn("hash", both).withWatermark("arrived", within).dropDuplicatesWithinWatermark(["hash"])
