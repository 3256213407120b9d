"""Functions for SQL: ``register`` names them in a session.

Blocks are values of a query here, so whole arrays and payloads cross to Python in
Arrow batches; everything that needs one value at a time is an expression of
``bits`` and ``decimals``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..codecs import registry


@pandas_udf("binary")
def encode_block(values: pd.Series, codec: pd.Series) -> pd.Series:
    """The payload of an array of numbers under a codec of the registry; null for a null array."""
    codecs = registry()
    kind = {"f8": np.float64, "f4": np.float32}
    return pd.Series([None if v is None else codecs[c].encode(np.asarray(v, kind[codecs[c].dtype])) for v, c in zip(values, codec)])


@pandas_udf("array<double>")
def decode_block(payload: pd.Series, n: pd.Series, codec: pd.Series) -> pd.Series:
    """The values of a payload; null for a null payload."""
    codecs = registry()
    return pd.Series([None if p is None else codecs[c].decode(bytes(p), int(k)).astype(np.float64) for p, k, c in zip(payload, n, codec)])


@udtf(returnType="pos: bigint, value: double")
class DecodeBlob:
    """decode_blob(payload, n, codec): a row for each value."""

    def eval(self, payload: bytes, n: int, codec: str):
        if payload is not None:
            yield from enumerate(registry()[codec].decode(bytes(payload), n).astype(np.float64).tolist())


def register(spark: SparkSession) -> None:
    """``encode_block``, ``decode_block`` and ``decode_blob`` for the SQL of this session."""
    spark.udf.register("encode_block", encode_block)
    spark.udf.register("decode_block", decode_block)
    spark.udtf.register("decode_blob", DecodeBlob)
