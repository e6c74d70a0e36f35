"""A cache of the entries used last, as the state of a stream: a bounded map per cache, read and written once a batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Entries of a cache.
MOST_ENTRIES = 32
USE = "cache string, seq bigint, key string, hit boolean, evicted string, entries int"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cache(StatefulProcessor):
    """Answers every use of a key with a hit or a miss, keeps the ``most`` keys used last, and forgets what was not used for ``ttl`` seconds.

    Uses of one batch are taken in the order of ``seq``; the map is bounded, so a batch reads it whole, works on it
    and writes back what changed.
    """

    def __init__(self, most: int, ttl: float | None):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "seq bigint, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        # oldest use first, as dicts keep the order in which keys were put
        held = dict(sorted(before.items(), key=lambda e: e[1]))
        uses = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, name, at in zip(uses["seq"].tolist(), uses["key"].tolist(), uses["at"].tolist(), strict=True):
            last = held.pop(name, None)
            hit = last is not None and (self.ttl is None or at - last[1] <= self.ttl)
            held[name] = (seq, at)
            evicted = None
            if len(held) > self.most:
                evicted = next(iter(held))
                del held[evicted]
            out.append((key[0], seq, name, hit, evicted, len(held)))
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, value in held.items():
            if before.get(name) != value:
                self.entries.updateValue((name,), value)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in USE.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in the store that knows maps; the session's setting returns after."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if was is None else spark.conf.set(_PROVIDER, was)


def uses(stream: DataFrame, most: int = MOST_ENTRIES, ttl: float | None = None) -> DataFrame:
    """USE for a stream of (cache, seq, key, at): at is the use's time in seconds."""
    return stream.groupBy("cache").transformWithStateInPandas(statefulProcessor=Cache(most, ttl), outputStructType=USE, outputMode="Append", timeMode="None")
