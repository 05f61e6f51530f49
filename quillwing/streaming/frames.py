"""Incremental assembly of framed messages in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.protocol import REQUEST_LIMIT, unframe_bytes


def assemble_frames(chunks: DataFrame, key_col: str = "connection", order_col: str = "seq", data_col: str = "data", limit: int = REQUEST_LIMIT) -> DataFrame:
    """Columns key_col, payload: the messages that chunks of a connection's bytes complete.

    Chunks may cut frames anywhere. A connection's state is the bytes of its
    unfinished message, at most ``limit`` and its frames' lengths; within a batch chunks are taken by ``order_col``.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = chunks.schema[key_col].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        left = bytes(state.get[0]) if state.exists else b""
        rows = pd.concat([left_ for left_ in frames]).sort_values(order_col)
        data, at, found = left + b"".join(bytes(x) for x in rows[data_col] if x is not None), 0, []
        while x := unframe_bytes(data, at, limit):
            found.append(x[0])
            at = x[1]
        if at < len(data):
            state.update((data[at:],))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key_col: [key[0]] * len(found), "payload": found})

    return chunks.groupBy(key_col).applyInPandasWithState(step, f"`{key_col}` {kind}, payload binary", "rest binary", "append", GroupStateTimeout.NoTimeout)
