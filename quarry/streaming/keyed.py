"""Keyed state of the revision merge: what a key held before a batch, from the RocksDB state store.

The state of a key is one row, its best by (revision, deleted), first arrival first. A batch reads and writes the keys it holds and
no others, so what is written follows the batch and not the table; a tombstone is a state like any other and is never dropped.
Keys are dealt into a fixed number of groups, so that Python takes a group's rows together and not a key's, one entry of the group's map
a key: what a call costs is paid once a group, and of a key only its reading and its writing. Rows of a group pass in pieces, in
any order, and of its keys in the batch only the best is kept: a key may hold a third of a batch.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The groups of keys; a state that is stored belongs to this number.
GROUPS, GROUP = 1024, "key_group"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}  # a piece: documents of 48,000 characters at most


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """A query that starts here keeps its state in RocksDB and writes the changes of each batch; the session's settings come back."""
    had = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def before(stream: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """A stream of (key, arrival, revision, deleted, skip, ...) with had_revision, had_deleted, had_rid and had_{kept}: the key's state before the batch.

    had_rid is the arrival that a key began with, null for a new one. Rows with skip pass and neither meet nor make a state.
    """
    fields = {f.name: f for f in stream.schema}
    numbers = [("rid", T.LongType()), ("revision", T.LongType()), ("deleted", T.BooleanType()), *((c, fields[c].dataType) for c in kept)]
    names = [n for n, _ in numbers]
    state = T.StructType([T.StructField(n, t) for n, t in numbers])
    out = T.StructType([*stream.schema.fields, *(T.StructField(f"had_{n}", t) for n, t in numbers)])
    plain = {T.LongType(): "Int64", T.IntegerType(): "Int32", T.BooleanType(): "boolean"}
    kinds = {f"had_{n}": plain.get(t, "object") for n, t in numbers}
    own = {f.name: plain[f.dataType] for f in stream.schema if f.dataType in plain}
    none = (None,) * len(names)

    def processor() -> StatefulProcessor:
        class Before(StatefulProcessor):  # made here, so that workers get it whole and need no import

            def init(self, handle):
                self.stored = handle.getMapState("stored", T.StructType([T.StructField("key", fields[key].dataType)]), state)

            def handleInputRows(self, group, rows, timers):
                had, best, first, when = {}, {}, {}, {}  # of the keys that this group has in this batch
                for part in rows:
                    part = part.drop(columns=GROUP).astype(own)
                    values = ([None if x is pd.NA or x is None else x for x in part[c].tolist()] for c in ("skip", key, "revision", "deleted", "arrival", *kept))
                    told = []
                    for skip, k, revision, deleted, arrival, *rest in zip(*values, strict=True):
                        if skip:
                            told.append(none)
                            continue
                        if k not in had:
                            had[k] = best[k] = self.stored.getValue((k,))
                            first[k] = had[k][0] if had[k] else arrival
                        told.append(had[k] or none)
                        if not had[k] and arrival < first[k]:
                            first[k] = arrival
                        pair, most = (revision, deleted), best[k] and tuple(best[k][1:3])
                        if most is None or pair > most or pair == most and k in when and arrival < when[k]:
                            when[k], best[k] = arrival, (None, *pair, *rest)
                    columns = zip(*told, strict=True)
                    yield part.assign(**{f"had_{n}": pd.Series(list(c), index=part.index, dtype=kinds[f"had_{n}"]) for n, c in zip(names, columns, strict=True)})
                for k in when:
                    self.stored.updateValue((k,), (first[k], *best[k][1:]))

            def close(self):
                pass

        return Before()

    grouped = stream.withColumn(GROUP, F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")).groupBy(GROUP)
    return grouped.transformWithStateInPandas(processor(), out, "append", "None")
