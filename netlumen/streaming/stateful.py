"""Keyed state for streams: flow assembly and live device state.

Both processors sort the rows of a key within a micro-batch and fold them; timers
close what no further row will close. State is one small row per key.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netlumen.functions.severity import BANDS, CLEAR_BELOW, SCALE
from netlumen.operators.flows import DEFAULT as TIMEOUTS
from netlumen.operators.flows import Timeouts, closings, keyed
from netlumen.operators.state import DEFAULT as DECAY
from netlumen.operators.state import Decay
from netlumen.schemas import CONNECTION_FIELDS, CONNECTION_STRINGS, LABEL_UNKNOWN

FLOW_OUTPUT = T.StructType(
    [T.StructField(n, T.StringType() if n in CONNECTION_STRINGS else T.DoubleType())
     for n in CONNECTION_FIELDS] + [T.StructField("reason", T.StringType())])
# The same on its way from Python: every column of a frame has its price, once per key.
_FLOW_TEXTS, _FLOW_NUMBERS = (*CONNECTION_STRINGS, "reason"), [f.name for f in FLOW_OUTPUT if isinstance(f.dataType, T.DoubleType)]
_FLOW_PACKED = T.StructType([T.StructField(n, T.StringType()) for n in _FLOW_TEXTS]
                            + [T.StructField("numbers", T.ArrayType(T.DoubleType()))])
# One JSON text per key: the accumulators of the open segment.
_TEXT_STATE = T.StructType([T.StructField("body", T.StringType())])
_FLAGS = (("syn", 2), ("ack", 16), ("fin", 1), ("rst", 4), ("psh", 8), ("urg", 32))


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros((F.col(ts) * 1e6).cast("long")))


# What is kept of an open segment, as columns of packets: sums, least and greatest values.
_SUMS = ("n", "n_resp", "bytes", "bytes_resp", "gap_n", "gap_sum", "gap_sq", "size_sq", "http",
         *(f"{name}_count" for name, _ in _FLAGS))
_LOWS, _HIGHS = {"gap_min": math.inf, "size_min": math.inf}, {"gap_max": 0.0, "size_max": 0.0, "sni": 0.0}


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = list(rows)
    batch = frames[0] if len(frames) == 1 else pd.concat(frames)
    # A closing event has a time and nothing else.
    return batch[batch["event_id"].notna()].sort_values(["ts", "event_id"], ignore_index=True)


def _segments(b: pd.DataFrame, s: dict | None, t: Timeouts) -> tuple[np.ndarray, list[str]]:
    """Starts of the segments of a key's packets, and why each ends ("" if it may go on).
    The first goes on with the open segment ``s`` if there is one."""
    ts, flags, low = b["ts"].to_numpy(), b["tcp_flags"].to_numpy(), b["from_low"].to_numpy(dtype=bool)
    n = len(ts)
    fin, rst = np.where(flags & 1, np.where(low, 1, 2), 0), (flags & 4) > 0
    runs = np.flatnonzero(np.append(True, np.diff(ts) >= t.idle))
    last = np.append(runs[1:], n)
    since, fins = ts[runs], np.bitwise_or.reduceat(fin, runs)
    if s:
        since[0], fins[0] = s["start"], fins[0] | s["fins"]
    may_close = (ts[last - 1] - since >= t.active) | (fins == 3) | np.logical_or.reduceat(rst, runs)
    starts, reasons = [], []
    for k, (lo, hi) in enumerate(zip(runs.tolist(), last.tolist())):
        had = s["fins"] if s and k == 0 else 0
        ends = closings(ts[lo:hi], fin[lo:hi], rst[lo:hi], float(since[k]), had, t) + lo if may_close[k] else ()
        at = lo
        for e in (int(x) for x in ends):
            seen = int(np.bitwise_or.reduce(fin[at:e + 1])) | (had if at == lo else 0)
            starts.append(at)
            reasons.append("closed" if rst[e] or seen == 3 else "active")
            at = e + 1
        if at < hi:
            starts.append(at)
            reasons.append("idle" if hi < n else "")
    return np.array(starts, np.int64), reasons


def _accumulated(b: pd.DataFrame, starts: np.ndarray, s: dict | None) -> list[dict]:
    """One state per segment, all segments of a key at once."""
    n = len(b)
    ts, flags, low = b["ts"].to_numpy(), b["tcp_flags"].to_numpy(), b["from_low"].to_numpy(dtype=bool)
    size = b["length"].to_numpy(dtype=float)
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    first_low = low[starts]
    gap = np.append(ts[0] - s["last"] if s else -1.0, np.diff(ts))
    gap[starts[1:] if s else starts] = -1.0                  # none before a segment's first packet
    if s:
        first_low[0] = s["low"]
    resp, timed = (low != first_low[which]).astype(float), gap >= 0
    kept = np.where(timed, gap, 0.0)
    columns = {"n": np.ones(n), "n_resp": resp, "bytes": size, "bytes_resp": size * resp, "gap_n": timed.astype(float),
               "gap_sum": kept, "gap_sq": kept * kept, "size_sq": size * size,
               "http": b["is_http_request"].to_numpy(dtype=float),
               **{f"{name}_count": ((flags & bit) > 0).astype(float) for name, bit in _FLAGS}}
    sums = {c: np.add.reduceat(columns[c], starts) for c in _SUMS}
    lows = {"gap_min": np.minimum.reduceat(np.where(timed, gap, np.inf), starts), "size_min": np.minimum.reduceat(size, starts)}
    highs = {"gap_max": np.maximum.reduceat(kept, starts), "size_max": np.maximum.reduceat(size, starts),
             "sni": np.maximum.reduceat(b["tls_sni_len"].to_numpy(dtype=float), starts)}
    fins = np.bitwise_or.reduceat(np.where(flags & 1, np.where(low, 1, 2), 0), starts)
    bins = (np.clip(size, 0, 65535).astype(np.int64)) // TIMEOUTS.size_bin
    cell, counts = np.unique(which * 65536 + bins, return_counts=True)
    ends = np.append(starts[1:], n) - 1
    out = []
    ends_of = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "event_id")
    opener = [dict(zip(ends_of, x)) for x in zip(*(b[c].to_numpy()[starts].tolist() for c in ends_of))]
    sides = {c: v.tolist() for part in (sums, lows, highs) for c, v in part.items()}
    started, ended, came_low, fins = ts[starts].tolist(), ts[ends].tolist(), first_low.tolist(), fins.tolist()
    places, counts = (cell % 65536).astype(str).tolist(), counts.tolist()
    where = np.searchsorted(cell, np.arange(len(starts) + 1) * 65536).tolist()
    for i, head in enumerate(opener):
        i0, i1 = where[i], where[i + 1]
        out.append({**head, "start": started[i], "last": ended[i], "low": came_low[i], "fins": fins[i],
                    "bins": dict(zip(places[i0:i1], counts[i0:i1])), **{c: v[i] for c, v in sides.items()}})
    if s:
        now = out[0]
        out[0] = {**s, "last": now["last"], "fins": s["fins"] | now["fins"],
                  "bins": {k: s["bins"].get(k, 0) + now["bins"].get(k, 0) for k in {**s["bins"], **now["bins"]}},
                  **{c: s[c] + now[c] for c in _SUMS}, **{c: min(s[c], now[c]) for c in _LOWS},
                  **{c: max(s[c], now[c]) for c in _HIGHS}}
    return out


def _moments(n: float, total: float, squares: float) -> tuple[float, float]:
    if not n:
        return 0.0, 0.0
    mean = total / n
    return mean, math.sqrt(max(squares / n - mean * mean, 0.0))


def _record(s: dict, hashed: str, reason: str) -> dict:
    n = s["n"]
    iat, size = _moments(s["gap_n"], s["gap_sum"], s["gap_sq"]), _moments(n, s["bytes"], s["size_sq"])
    entropy = -sum(c / n * math.log2(c / n) for c in s["bins"].values())
    return {
        "flow_id": f"c-{hashed}-{s['event_id']}", "src_ip": s["src_ip"], "dst_ip": s["dst_ip"],
        "src_port": s["src_port"], "dst_port": s["dst_port"], "protocol": s["protocol"], "start_ts": s["start"],
        "emit_ts": s["last"], "duration": max(s["last"] - s["start"], 0.0),
        "orig_bytes": s["bytes"] - s["bytes_resp"], "resp_bytes": s["bytes_resp"],
        "orig_pkts": n - s["n_resp"], "resp_pkts": s["n_resp"],
        **{f"{name}_count": s[f"{name}_count"] for name, _ in _FLAGS},
        "iat_mean": iat[0], "iat_std": iat[1], "iat_min": 0.0 if math.isinf(s["gap_min"]) else s["gap_min"],
        "iat_max": s["gap_max"], "pkt_size_mean": size[0], "pkt_size_std": size[1], "pkt_size_min": s["size_min"],
        "pkt_size_max": s["size_max"], "payload_entropy": max(entropy, 0.0) + 0.0,   # no negative zero
        "tls_present": float(s["sni"] > 0), "tls_sni_len": s["sni"],
        "http_present": float(s["http"] > 0), "http_req_count": s["http"], "label": LABEL_UNKNOWN,
        "reason": reason}


def _frame(rows: list[dict], schema: T.StructType) -> Iterator[pd.DataFrame]:
    # Typed column by column before the frame is made: casting columns of a frame costs far more than a key's rows.
    if rows:
        yield pd.DataFrame({f.name: np.array([r[f.name] for r in rows], "float64" if isinstance(f.dataType, T.DoubleType) else None)
                            if not isinstance(f.dataType, T.StringType) else np.array([r[f.name] for r in rows], object)
                            for f in schema}, copy=False)


def _packed(rows: list[dict]) -> Iterator[pd.DataFrame]:
    if rows:
        numbers = np.empty(len(rows), object)
        numbers[:] = [np.array([r[n] for n in _FLOW_NUMBERS], "float64") for r in rows]
        yield pd.DataFrame({**{n: np.array([r[n] for r in rows], object) for n in _FLOW_TEXTS}, "numbers": numbers}, copy=False)


def _unpacked(packed: DataFrame) -> DataFrame:
    # What is no number in a frame is NULL in a table.
    number = {n: F.col("numbers")[i] for i, n in enumerate(_FLOW_NUMBERS)}
    return packed.select(*[F.when(~F.isnan(number[n]), number[n]).alias(n) if n in number else n for n in FLOW_OUTPUT.names])


class FlowAssembler(StatefulProcessor):
    """Packets of one conversation to connection records. A closed segment leaves no state:
    its name comes from the conversation and its first packet."""

    def __init__(self, timeouts: Timeouts = TIMEOUTS):
        self.t = timeouts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", _TEXT_STATE)

    def _load(self) -> dict | None:
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def handleInputRows(self, key, rows, timerValues):
        s, b = self._load(), _sorted(rows)
        if not len(b):
            return
        hashed, out = b["key_hash"].iloc[0], []
        if s and b["ts"].iloc[0] - s["last"] >= self.t.idle:
            out.append(_record(s, hashed, "idle"))
            s = None
        starts, reasons = _segments(b, s, self.t)
        states = _accumulated(b, starts, s)
        out += [_record(x, hashed, why) for x, why in zip(states, reasons) if why]
        if reasons[-1]:
            self.state.clear()
        else:
            self.state.update((json.dumps({**states[-1], "hash": hashed}),))
            # One timer per update; those that were overtaken are recognised when they fire.
            self.handle.registerTimer(self._due(states[-1]))
        yield from _packed(out)

    def _due(self, s: dict) -> int:
        return int(math.ceil((s["last"] + self.t.idle) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = self._load()
        if s and self._due(s) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield from _packed([_record(s, s["hash"], "idle")])

    def close(self) -> None:
        pass


def assemble_flows(packets: DataFrame, lateness: str, timeouts: Timeouts = TIMEOUTS) -> DataFrame:
    """Stream of packets to stream of closed connection records. Packets more than
    ``lateness`` behind are dropped: part them off first with ``jobs.late_rows``."""
    rows = event_time(keyed(packets)).withColumn(
        "key_hash", F.substring(F.sha2("flow_key", 256), 1, 12))
    return _unpacked(rows.withWatermark("event_time", lateness).groupBy("flow_key").transformWithStateInPandas(
        FlowAssembler(timeouts), _FLOW_PACKED, "append", "EventTime"))


STATE_OUTPUT = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("at", T.DoubleType()),
    T.StructField("cause", T.StringType()), T.StructField("flow_id", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("alert_count", T.LongType()), T.StructField("alert_count_window", T.LongType()),
    T.StructField("top_peers", T.StringType()), T.StructField("top_ports", T.StringType())])


def _band(score: float) -> str:
    return next((name for name, bound in BANDS if score >= bound), "info")


class NodeStateKeeper(StatefulProcessor):
    """Live severity of one device. Emits on every alert, on acknowledgement and
    whenever cooling takes the device into a lower band. Cooling is analytic, so a
    timer is set for the instant the next band is reached instead of sweeping."""

    def __init__(self, decay: Decay = DECAY):
        self.d = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("node", _TEXT_STATE)
        # Alerts of the rolling window: a count per instant, a row of state each.
        self.recent = handle.getMapState("recent", "at double", "n long")

    def _load(self) -> dict | None:
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def _cooled(self, s: dict, at: float) -> float:
        gap = max(at - s["last"], 0.0)
        if gap <= self.d.dwell:
            return s["score"]
        return s["score"] * 0.5 ** ((gap - self.d.dwell) / self.d.half_life)

    def _next_drop(self, s: dict, below: str) -> float:
        """When the score falls under the lower bound of band ``below``."""
        bound = dict(BANDS).get(below, CLEAR_BELOW)
        fall = self.d.half_life * math.log2(s["score"] / bound) if s["score"] > bound else 0.0
        return s["last"] + self.d.dwell + fall

    def _due(self, s: dict) -> int:
        return int(self._next_drop(s, s["severity"]) * 1000) + 1

    def _keep(self, s: dict | None) -> None:
        if s is None:
            self.state.clear()
            return
        s["due"] = self._due(s)
        self.handle.registerTimer(s["due"])
        self.state.update((json.dumps(s),))

    def _cool_until(self, key, s: dict | None, until_ms: float, out: list[dict]) -> dict | None:
        """Emits every band left by then; a device that has faded out is forgotten."""
        while s is not None and (due := self._due(s)) <= until_ms:
            s["now"] = self._cooled(s, due / 1000)
            clear = s["now"] < CLEAR_BELOW
            s.update(severity="none", now=0.0) if clear else s.update(severity=_band(s["now"]))
            out.append(self._row(key[0], s, due / 1000, "cooling"))
            s = None if clear else s
        return s

    def _row(self, key, s: dict, at: float, cause: str, flow_id: str = "") -> dict:
        return {"node_id": key, "at": at, "cause": cause, "flow_id": flow_id,
                "severity": s["severity"], "score": s["now"], "alert_count": s["count"],
                "alert_count_window": s["window"], "top_peers": ",".join(s["peers"]),
                "top_ports": ",".join(map(str, s["ports"]))}

    def _window(self, inside: int, at: float, counts: dict[float, int]) -> int:
        """One more alert besides the ``inside`` that the window held, less those that have
        left it by now; ``counts`` rises in time."""
        counts[at] = counts.get(at, 0) + 1
        left = list(itertools.takewhile(lambda x: x < at - self.d.window, counts))
        return inside + 1 - sum(counts.pop(old) for old in left)

    def handleInputRows(self, key, rows, timerValues):
        s = self._load()
        out: list[dict] = []
        batch = pd.concat(list(rows))
        batch = batch[batch["node_id"].notna()].sort_values(["ts", "is_ack", "event_id"], ascending=[True, False, True])
        if not len(batch):                                   # a closing event
            return
        held = {k[0]: v[0] for k, v in self.recent.iterator()} if s else {}
        counts = dict(sorted(held.items()))
        for a in batch.itertuples(index=False):
            s = self._cool_until(key, s, a.ts * 1000, out)
            if a.is_ack:
                if s:
                    s.update(severity="none", now=0.0)
                    out.append(self._row(key[0], s, a.ts, "ack"))
                    s = None
                continue
            if s is None:
                counts = {}
            kept = self._cooled(s, a.ts) if s else 0.0
            s = s or {"count": 0, "peers": [], "ports": []}
            s["score"] = s["now"] = max(kept, a.score)
            s["severity"], s["last"], s["count"] = _band(s["score"]), a.ts, s["count"] + 1
            s["window"] = self._window(s.get("window", 0), a.ts, counts)
            peer, port = a.peer_node_id or a.dst_ip, int(a.dst_port or 0)
            if peer:
                s["peers"] = ([peer] + [x for x in s["peers"] if x != peer])[:5]
            if port:
                s["ports"] = ([port] + [x for x in s["ports"] if x != port])[:5]
            out.append(self._row(key[0], s, a.ts, "alert", a.flow_id))
        self._keep(s)
        self._remember(held, counts if s else {})
        yield from _frame(out, STATE_OUTPUT)

    def _remember(self, held: dict[float, int], counts: dict[float, int]) -> None:
        """Writes only the instants whose count changed."""
        for at in held.keys() - counts.keys():
            self.recent.removeKey((at,))
        for at, n in counts.items():
            if held.get(at) != n:
                self.recent.updateValue((at,), (n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = self._load()
        due = expiredTimerInfo.getExpiryTimeInMs()
        out: list[dict] = []
        if s and s["due"] == due:                      # otherwise a newer timer is armed
            # The watermark may have passed several bands at once.
            s = self._cool_until(key, s, max(due, timerValues.getCurrentWatermarkInMs()), out)
            self._keep(s)
            if s is None:
                self.recent.clear()
        yield from _frame(out, STATE_OUTPUT)

    def close(self) -> None:
        pass


def live_states(alerts: DataFrame, lateness: str, decay: Decay = DECAY) -> DataFrame:
    """Stream of attributed alerts (and acknowledgements, ``is_ack``) to state changes."""
    rows = alerts if "is_ack" in alerts.columns else alerts.withColumn("is_ack", F.lit(False))
    rows = event_time(rows.select("node_id", "ts", "event_id", "flow_id", "score", "is_ack",
                                  "peer_node_id", "dst_ip", "dst_port"))
    return (rows.withWatermark("event_time", lateness).groupBy("node_id")
            .transformWithStateInPandas(NodeStateKeeper(decay), STATE_OUTPUT, "append", "EventTime"))


assert SCALE[0] == "none"
