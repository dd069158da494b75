"""Streaming partitioners: the batch step functions behind a stateful operator.

All rows of one graph share a key, since every decision depends on all earlier ones. The state is the pickled partitioner; rows of
a micro-batch are sorted by ``seq`` before they are folded, so the cut into micro-batches doesn't matter as long as it keeps the order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def processor(make: Callable[[], Any], columns: list[str], names: list[str]) -> type[StatefulProcessor]:
    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("partitioner", "data binary, n long")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            data, n = self.state.get() if self.state.exists() else (None, 0)
            p = pickle.loads(bytes(data)) if data is not None else make()
            batch = pd.concat(list(rows)).sort_values("seq")
            found = [x for row in zip(*(batch[c].tolist() for c in columns), strict=True) for x in p.step(row)]
            self.state.update((bytearray(pickle.dumps(p)), n + len(found)))
            if found:
                out = pd.DataFrame(found, columns=names)
                out.insert(0, "assign_seq", range(n, n + len(found)))
                yield out

        def close(self) -> None:
            pass

    return Fold


def assign_stream(rows: DataFrame, make: Callable[[], Any], columns: list[str], out: str) -> DataFrame:
    """Assignments of a stream with columns ``seq`` and ``columns``; ``make`` builds the partitioner that starts the state.

    Needs the RocksDB state store provider (see :func:`configure`).
    """
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    keyed = rows.select(F.lit("graph").alias("graph"), "seq", *columns)
    return keyed.groupBy("graph").transformWithStateInPandas(statefulProcessor=processor(make, columns, names)(), outputStructType=f"assign_seq long, {out}", outputMode="Append", timeMode="None")


def configure(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def round_robin_stream(rows: DataFrame, k: int) -> DataFrame:
    """Stateless, as arrival numbers are in the data."""
    return rows.withColumn("part", F.pmod(F.col("seq"), F.lit(k)).cast("int"))
