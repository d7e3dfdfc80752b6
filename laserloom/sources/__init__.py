"""Readers and writers of the usual file formats as Spark data sources."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the formats ascgrid, dbf, shapefile, sbet, trj and las known to a session."""
    from laserloom.sources.ascgrid import AscGrid
    from laserloom.sources.binary import Las, Sbet, Trj
    from laserloom.sources.dbf import Dbf
    from laserloom.sources.shapefile import Shapefile

    for s in (AscGrid, Dbf, Shapefile, Sbet, Trj, Las):
        spark.dataSource.register(s)
