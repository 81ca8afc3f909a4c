"""Tables written batch by batch, of which a batch becomes visible in all at once.

A batch writes a part of each table; then its state file, renamed into place, names the parts that are to be read. A
batch that broke off between two tables is written anew under the same name, and one whose state stands is passed over. A
batch's clock is written before its first part, so that a second attempt decides as the first did.

Parts are laid out by day and group of devices (``CELLS``), so that a reader of some cells lists and reads no others. ``FANOUT``
parts of one level are merged to one of the next level: what is listed grows with the logarithm of the number of batches, and a
row is rewritten as often as that. Parts that were merged go two states later, when no reader of the state before needs them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT, GROUPS, DAY_MS = 8, 64, 86_400_000
CELLS = ("day", "grp")
#: Cells of a batch that are named in a filter; more are joined.
MOST_CELLS = 2000
#: Batches whose facts the state keeps.
RECENT = 200


def day_of(t_ms: str = "t_ms") -> Column:
    return F.floor(F.col(t_ms) / DAY_MS).cast("int")


def group_of(device: str = "device_id") -> Column:
    return F.pmod(F.xxhash64(device), F.lit(GROUPS)).cast("int")


def celled(rows: DataFrame, t_ms: str = "t_ms") -> DataFrame:
    return rows.withColumns({"day": day_of(t_ms), "grp": group_of()})


class Store:
    """Small files in the folder's file system, whatever that is."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self.path, self.io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, path: str) -> str | None:
        at = self.path(path)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """A file that is there whole or not at all."""
        aside = self.path(f"{path}.{time.time_ns()}.tmp")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(aside, self.path(path)) and not self.fs.exists(self.path(path)):
            raise OSError(f"{path} can't be written")

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class Ledger:
    """The tables under a folder. merges says for a table how the rows of several parts become those of one (else they stay as they are)."""

    def __init__(self, spark: SparkSession, folder: str, merges: dict[str, Callable[[DataFrame], DataFrame]] | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.merges, self.fanout = spark, folder, merges or {}, fanout
        self.store, self.added = Store(spark, folder), {}

    def state(self) -> dict | None:
        """What the last whole batch left."""
        names = [n for n in self.store.names(f"{self.folder}/state") if n.endswith(".json")]
        return json.loads(self.store.text(f"{self.folder}/state/{names[-1]}")) if names else None

    def clock(self, batch: int, now: Callable[[], float] = time.time) -> float:
        """The time at which a batch was first begun."""
        path = f"{self.folder}/clock/{batch:012d}"
        if (known := self.store.text(path)) is None:
            self.store.put(path, known := repr(now()))
        return float(known)

    def done(self, batch: int) -> bool:
        state = self.state()
        return state is not None and state["batch"] >= batch

    def add(self, name: str, rows: DataFrame, batch: int, cells: bool = False) -> DataFrame:
        """Writes a batch's part of a table and reads it again."""
        part = f"part=0-{batch}"
        self._write(rows, f"{self.folder}/{name}/{part}", cells)
        schema = StructType(list(rows.schema.fields)).json()
        self.added[name] = (part, schema, cells)
        return self._read(name, [part], schema)

    def _write(self, rows: DataFrame, path: str, cells: bool) -> None:
        out = rows
        if cells:  # a cell's rows in few files, in order of time; large cells are split
            out = rows.hint("rebalance", *CELLS).sortWithinPartitions(*CELLS, *[c for c in ("device_id", "t_ms", "bucket_ms") if c in rows.columns])
        writer = out.write.mode("overwrite")
        (writer.partitionBy(*CELLS) if cells else writer).parquet(path)

    def _read(self, name: str, parts: list[str], schema: str) -> DataFrame:
        base = f"{self.folder}/{name}"
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/{p}" for p in parts]).select(*kind.names)

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        """The rows of all whole batches, or None before the first."""
        state = state or self.state()
        known = (state or {}).get("tables", {}).get(name)
        return self._read(name, known["parts"], known["schema"]) if known else None

    def read_cells(self, name: str, cells: DataFrame, state: dict | None = None) -> DataFrame | None:
        """The rows of some cells (day, grp); no folder of others is read."""
        rows = self.read(name, state)
        if rows is None:
            return None
        listed = cells.select(*CELLS).distinct().limit(MOST_CELLS + 1).collect()
        if len(listed) > MOST_CELLS:
            return rows.join(cells.select(*CELLS).distinct(), list(CELLS), "left_semi").select(*rows.columns)
        by_day: dict[int, list[int]] = {}
        for day, grp in listed:
            by_day.setdefault(day, []).append(grp)
        wanted = F.lit(False)
        for day, groups in sorted(by_day.items()):
            wanted = wanted | ((F.col("day") == day) & F.col("grp").isin(groups))
        return rows.where(wanted)

    def commit(self, batch: int, **facts) -> dict:
        """Makes a batch's parts visible, with its facts; merges parts where a level is full."""
        old = self.state() or {"batch": -1, "tables": {}, "recent": [], "gone": [], "totals": {}}
        tables, gone = {k: dict(v) for k, v in old["tables"].items()}, []
        for name, (part, schema, cells) in self.added.items():
            known = tables.setdefault(name, {"parts": [], "schema": schema, "cells": cells})
            known["parts"] = [*known["parts"], part]
            gone += self._merge(name, known, batch)
        totals = dict(old["totals"])
        for k, v in facts.items():
            if isinstance(v, int):
                totals[k] = totals.get(k, 0) + v
        recent = [*old["recent"], {"batch": batch, **facts}][-RECENT:]
        state = {"batch": batch, "tables": tables, "recent": recent, "totals": totals, "gone": gone}
        self.store.put(f"{self.folder}/state/{batch:012d}.json", json.dumps(state))
        self.added = {}
        self._clean(old, batch)
        return state

    def _merge(self, name: str, known: dict, batch: int) -> list[str]:
        gone, level = [], 0
        while len(full := [p for p in known["parts"] if p.startswith(f"part={level}-")]) >= self.fanout:
            rows = self._read(name, full, known["schema"])
            rows = self.merges[name](rows) if name in self.merges else rows
            level += 1
            merged = f"part={level}-{batch}"
            self._write(rows.select(*StructType.fromJson(json.loads(known["schema"])).names), f"{self.folder}/{name}/{merged}", known["cells"])
            known["parts"] = [p for p in known["parts"] if p not in full] + [merged]
            gone += [f"{name}/{p}" for p in full]
        return gone

    def _clean(self, old: dict, batch: int) -> None:
        """Drops parts that the state before the last had merged, states before that, and old clocks."""
        for path in old["gone"]:
            self.store.drop(f"{self.folder}/{path}")
        for name in self.store.names(f"{self.folder}/state"):
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) < old["batch"]:
                self.store.drop(f"{self.folder}/state/{name}")
        for name in self.store.names(f"{self.folder}/clock"):
            if name.isdigit() and int(name) < batch:
                self.store.drop(f"{self.folder}/clock/{name}")


def latest_of(*keys: str, by: str = "batch") -> Callable[[DataFrame], DataFrame]:
    """Of rows with equal keys, all those of the latest batch (which have one row a key each)."""

    def merge(rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), by).alias("_r")).select(*keys, "_r.*")

    return merge
