"""Cooldown as a stream: what was used in the last rows before each, in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.checkpoints import shipped

#: The store that list state needs; to be set before a session's first stateful stream.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Recent(StatefulProcessor):
    """A bounded list for each group: the keys of its last rows."""

    def __init__(self, order: str, key: str, most: int):
        self.order, self.key, self.most = order, key, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "key string")

    def handleInputRows(self, group, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [k for (k,) in self.kept.get()] if self.kept.exists() else []
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        every = last + [None if pd.isna(k) else str(k) for k in new[self.key]]
        recent = [sorted({k for k in every[max(0, i - self.most) : i] if k is not None}) for i in range(len(last), len(every))]
        self.kept.put([(k,) for k in every[-self.most :]])
        yield pd.DataFrame({"group": [group[0]] * len(new), self.order: new[self.order].to_numpy(), "recent": recent})

    def close(self) -> None:
        pass


def running_recent(stream: DataFrame, group: str, order: str, key: str, most: int = 64) -> DataFrame:
    """W3, P12 as a stream: for each row its group, its order and ``recent``, the distinct keys of the ``most`` rows before it.

    State is ``most`` keys a group, whatever has passed.  Rows of a trigger are
    taken in order; one that comes in a later trigger than rows after it counts as
    coming last, so this equals the batch operator where triggers come in order.
    """
    spark = shipped(stream.sparkSession)
    spark.conf.set(*STORE)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = stream.select(group, order, stream[key].cast("string").alias(key))
    schema = f"`group` {kinds[group]}, `{order}` {kinds[order]}, recent array<string>"
    return rows.groupBy(group).transformWithStateInPandas(_Recent(order, key, most), schema, "Append", "None").withColumnRenamed("group", group)
