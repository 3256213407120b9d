"""Compressing series as they arrive.

A stateful operator holds, for each series, the values of its unfinished block;
whole blocks leave as rows of the compressed table. Position is the order of
arrival within a batch by ``pos``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..codecs import registry

SCHEMA = "series_id string, block_id long, n long, min_value double, max_value double, payload binary"


def compress_stream(values: DataFrame, codec: str = "planes", block: int | None = None) -> DataFrame:
    """Blocks of a streaming (series_id, pos, value), each emitted when it is full; the rest of a
    series stays in the state and is bounded by one block."""
    size = block or registry()[codec].block

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = registry()[codec]
        held, number = state.get if state.exists else (b"", 0)
        parts = [np.frombuffer(held, np.float64)]
        new = pd.concat([f[["pos", "value"]] for f in frames]).sort_values("pos")
        parts.append(new["value"].to_numpy(np.float64))
        values_now = np.concatenate(parts)
        rows = []
        while len(values_now) >= size:
            v, values_now = values_now[:size], values_now[size:]
            good = v[~np.isnan(v)]
            rows.append((key[0], number, len(v), float(good.min()) if len(good) else None, float(good.max()) if len(good) else None, one.encode(v)))
            number += 1
        state.update((values_now.tobytes(), number))
        yield pd.DataFrame(rows, columns=["series_id", "block_id", "n", "min_value", "max_value", "payload"])

    return values.groupBy("series_id").applyInPandasWithState(run, SCHEMA, "held binary, number long", "append", GroupStateTimeout.NoTimeout)


def write_blocks(values: DataFrame, path: str, checkpoint: str, codec: str = "planes"):
    """Start a query that compresses each micro-batch by itself into ``path``; a block never spans batches."""
    from ..operators.compress import compress

    def sink(batch: DataFrame, number: int) -> None:
        compress(batch, codec).write.mode("append").parquet(path)

    return values.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
