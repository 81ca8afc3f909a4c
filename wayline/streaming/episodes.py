"""Episodes on a stream, with state for each device, or each device and hour."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.constants import RULES
from ..functions.scalars import ground_speed, peak_deviation
from ..operators.timeline import SLICE_MS, sliced

OUT = "device_id string, kind string, start_ms bigint, end_ms bigint, peak double, samples bigint"
GAP_MS = 3000


def stream_episodes(signals: DataFrame, kind: str, version: int = 1, gap_ms: int = GAP_MS) -> DataFrame:
    """Updates of the episodes of one kind: the last row of a (device_id, start_ms) is its state.

    signals: device_id, t_ms and value, which is null for a row without the signal; such a row
    ends an episode, as does a gap. State holds the open episode and the rules' version, so
    an episode goes on after a restart and new rules begin anew. Rows of a batch are put in
    order; rows older than the last seen are left to the rebuild.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, start, peak, n = state.get if state.exists else (None, version, None, 0.0, 0)
        if seen != version:
            last, start, peak, n = None, None, 0.0, 0
        rows, out = pd.concat(list(frames)).sort_values("t_ms"), []
        for t, value in zip(rows["t_ms"].tolist(), rows["value"].tolist()):
            if last is not None and t <= last:
                continue
            if start is not None and (t - last > gap_ms or value != value):
                out.append((key[0], kind, start, last, peak, n))
                start = None
            if value == value:
                start, peak, n = (t, value, 1) if start is None else (start, max(peak, value), n + 1)
            last = t
        if start is not None:
            out.append((key[0], kind, start, last, peak, n))
        state.update((last, version, start, peak, n))
        if out:
            yield pd.DataFrame(out, columns=["device_id", "kind", "start_ms", "end_ms", "peak", "samples"])

    return signals.groupBy("device_id").applyInPandasWithState(step, OUT, "last_ms bigint, version int, start_ms bigint, peak double, n bigint", "update", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALL_OUT = "device_id string, kind string, start_ms bigint, end_ms bigint, peak double, peak_ms bigint, samples bigint, joined boolean, version int, state string"
FAR_MS, NEAR_MS = 1500, 800
#: The kinds and the limits of each.
LIMITS = {"overspeed": "speed_kmh", "acceleration": "accel_ms2", "braking": "brake_ms2", "roll": "roll_deg", "pitch": "pitch_deg", "shock": "shock_g"}
ROW = ["t_ms", "protocol", "speed", "roll", "pitch", "shock"]
TOLD = ["kind", "start_ms", "end_ms", "peak", "peak_ms", "samples", "joined", "closed"]


def rule_inputs(points: DataFrame) -> DataFrame:
    """What the rules look at of each point of a stream: device_id, at (its time), t_ms, protocol, speed (effective), roll, pitch and shock.

    Rows of the measurement view have their effective speed; of others it is made of the row by itself, so that a drift of the position isn't seen.
    """
    speed = F.col("speed") if "motion_state" in points.columns else ground_speed()["value"]
    return points.select("device_id", F.timestamp_millis("t_ms").alias("at"), "t_ms", "protocol", speed.alias("speed"), F.abs("roll").alias("roll"), F.abs("pitch").alias("pitch"), peak_deviation().alias("shock"))


def _packed(frame: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    frame.reset_index(drop=True).to_feather(out)
    return out.getvalue()


def _unpacked(data: bytes | None, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(columns=columns) if data is None else pd.read_feather(io.BytesIO(data))


class Detector(StatefulProcessor):
    """The episodes of one device within one hour, of all kinds.

    State has the rows of the last hold_ms and of an episode that goes on, so that a late row stands among its neighbours as if it had
    been in time: episodes of these rows are found anew, and those that differ from what was told are told again (gone, if no longer there). Rows
    older than that are told as late, for the rebuild. Rules of a new version begin with no state. An event-time timer tells an episode closed
    when no row can go on with it, and drops the state of an hour of which no row can come any more.

    The last rows of the hour before come as guests: they make no episodes, but tell whether the hour's first part goes on from there (joined).
    """

    def __init__(self, rules: dict, version: int, gap_ms: int, hold_ms: int):
        self.rules, self.version, self.gap_ms, self.hold_ms = rules, version, gap_ms, hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        # Rows and what was told are tables in Arrow's format: a state that holds an hour is read and written at once.
        self.hour = handle.getValueState("hour", "version int, upto bigint, newest bigint, rows binary, told binary")

    def handleInputRows(self, key, rows, timerValues):
        device, hour = key
        version, upto, newest, held, told = self.hour.get() if self.hour.exists() else (self.version, -1, -1, None, None)
        if version != self.version:
            upto, held, told = newest, None, None
        new = pd.concat(list(rows))[ROW]
        at = new["t_ms"].to_numpy()
        late = int(((at <= upto) & (at // SLICE_MS == hour)).sum())
        new = new[at > upto].sort_values(ROW)
        if len(new):
            newest = max(newest, int(new["t_ms"].max()))
        kept = pd.concat([_unpacked(held, ROW), new]) if held is not None else new
        kept = kept.drop_duplicates(ROW[:2]).sort_values(ROW[:2])
        t = kept["t_ms"].to_numpy(dtype="int64")
        values = self._values(t, kept)
        over = values > np.array([self.rules[name] for name in LIMITS.values()])
        found = self._parts(t, values, over, (t // SLICE_MS == hour) & (t > upto), upto)
        told = {tuple(r[:2]): tuple(r[2:]) for r in _unpacked(told, TOLD).to_numpy(dtype=object).tolist()}
        out = [("late", upto, upto, 0.0, upto, late, False, "late")] if late else []
        now = {}
        for k, v in found.items():
            was = told.get(k, ())
            now[k] = was if was[:5] == v else (*v, False)
            if was[:5] != v:
                out.append((*k, *v, "open"))
        for k, v in told.items():
            if k not in found and k[1] > upto:
                out.append((*k, *v[:3], 0, v[4], "gone"))
        upto = self._cut(t, over, upto, newest - self.hold_ms)
        # No row can change what ends before.
        out += [(*k, *v[:5], "closed") for k, v in now.items() if v[0] <= upto and not v[5]]
        now = [(*k, *v) for k, v in now.items() if v[0] > upto]
        self.hour.update((self.version, upto, newest, _packed(kept[t > upto - FAR_MS]), _packed(pd.DataFrame(now, columns=TOLD)) if now else None))
        self.handle.registerTimer(max(newest + self.gap_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield self._told(device, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.hour.exists():
            return
        device, hour = key
        version, upto, newest, held, told = self.hour.get()
        told, now = _unpacked(told, TOLD), timerValues.getCurrentWatermarkInMs()
        past = now >= (hour + 1) * SLICE_MS  # rows before the watermark don't come any more
        over = ~told["closed"].astype(bool) & (past | (told["end_ms"] + self.gap_ms < now))
        out = told[over].drop(columns="closed").to_numpy(dtype=object).tolist()
        if past:
            self.hour.clear()
        else:
            self.hour.update((version, upto, newest, held, _packed(told.assign(closed=told["closed"].astype(bool) | over)) if len(told) else None))
            self.handle.registerTimer(max((hour + 1) * SLICE_MS, now + 1))
        if out:
            yield self._told(device, [(*r, "closed") for r in out], version)

    def close(self) -> None:
        pass

    def _told(self, device: str, rows: list[tuple], version: int | None = None) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*TOLD[:-1], "state"]).assign(device_id=device, version=self.version if version is None else version)
        return out[[c.split()[0] for c in ALL_OUT.split(", ")]]

    def _values(self, t: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        """What the limits of each kind are held against, a column a kind; the acceleration is that from the oldest row between FAR_MS and NEAR_MS before."""
        speed, roll, pitch, shock = (rows[c].to_numpy(dtype="float64") for c in ROW[2:])
        base = np.searchsorted(t, t - FAR_MS)
        before = t[base] <= t - NEAR_MS
        seconds = np.where(before, t - t[base], 1) / 1000
        accel = np.where(before, (speed - speed[base]) / seconds, np.nan)
        return np.stack([speed * 3.6, accel, -accel, roll, pitch, shock], axis=1)

    def _parts(self, t: np.ndarray, values: np.ndarray, over: np.ndarray, own: np.ndarray, upto: int) -> dict:
        """end_ms, peak, peak_ms, samples and joined by kind and start_ms."""
        near, out = np.zeros(len(t), dtype=bool), {}
        near[1:] = (np.diff(t) <= self.gap_ms) & (t[:-1] > upto)
        for k, kind in enumerate(LIMITS):
            at = np.flatnonzero(over[:, k] & own)
            if not len(at):
                continue
            goes_on = near.copy()
            goes_on[1:] &= over[:-1, k]
            new = ~goes_on[at]
            joined = not new[0]  # only a guest can stand before the hour's first row of the kind
            new[0] = True
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            value, when = values[at, k], t[at]
            peak = np.maximum.reduceat(value, first)
            peak_ms = np.minimum.reduceat(np.where(value == peak[np.cumsum(new) - 1], when, np.iinfo("int64").max), first)
            for i, v in enumerate(zip(when[first].tolist(), when[last].tolist(), peak.tolist(), peak_ms.tolist(), (last - first + 1).tolist())):
                out[kind, v[0]] = (*v[1:], joined and i == 0)
        return out

    def _cut(self, t: np.ndarray, over: np.ndarray, upto: int, wanted: int) -> int:
        """The last time up to which rows can go: not after wanted, and not within an episode."""
        a, b = t[:-1], t[1:]
        at = a[(a <= wanted) & (a > upto) & (b > a) & ((b - a > self.gap_ms) | ~(over[:-1] & over[1:]).any(axis=1))]
        return int(at[-1]) if len(at) else upto


def stream_all_episodes(inputs: DataFrame, rules: dict = RULES, version: int = 1, gap_ms: int = GAP_MS, hold_ms: int = 600_000) -> DataFrame:
    """Updates of the episodes of all kinds of a stream of rule_inputs: the last row of a (device_id, kind, start_ms) is its state (open, closed or gone).

    State and work are those of a device's hour, so an episode that goes on over full hours is told in parts, of which all but the first are joined: ``whole_episodes``.
    """
    inputs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    reach = FAR_MS + gap_ms  # what decides on the hour's first row
    hold_ms = max(hold_ms, reach)
    timed = sliced(inputs.withWatermark("at", f"{hold_ms} milliseconds"), reach).drop("_own")
    return timed.groupBy("device_id", "_slice").transformWithStateInPandas(Detector(rules, version, gap_ms, hold_ms), ALL_OUT, "Update", "eventTime")


def whole_episodes(parts: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Episodes (device_id, kind, start_ms, end_ms, peak, peak_ms, samples) from the last state of each part, those that are gone left out.

    Only parts at full hours are put in order.
    """
    cols = ["device_id", "kind", "start_ms", "end_ms", "peak", "peak_ms", "samples"]
    edge = F.col("joined") | (F.pmod("end_ms", F.lit(SLICE_MS)) >= SLICE_MS - gap_ms)
    w = Window.partitionBy("device_id", "kind").orderBy("start_ms", "end_ms")
    goes_on = F.col("joined") & (F.lag("version").over(w) == F.col("version")) & (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms)
    runs = parts.where(edge).withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    peak = F.max(F.struct("peak", (-F.col("peak_ms")).alias("at")))
    merged = runs.groupBy("device_id", "kind", "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), peak.alias("_p"), F.sum("samples").alias("samples"))
    merged = merged.select("device_id", "kind", "start_ms", "end_ms", F.col("_p.peak").alias("peak"), (-F.col("_p.at")).alias("peak_ms"), "samples")
    return parts.where(~edge).select(*cols).unionByName(merged)
