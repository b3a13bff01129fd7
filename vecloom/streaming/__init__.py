"""Codes for vectors that arrive on a stream."""

from pyspark.sql import DataFrame

from vecloom.operators.kmeans import Model, assign


def encode_stream(stream: DataFrame, model: Model) -> DataFrame:
    """Adds PQ codes to a stream of (vec_id, embedding); stateless, so any output mode and trigger will do."""
    return assign(stream, model)
