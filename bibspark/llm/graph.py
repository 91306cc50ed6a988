"""Connected components, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import graph
from . import files


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex that an edge (u, v) of longs touches; root is its component's least vertex."""
    return graph.components(edges, files.rounds(spark, "edges"))
