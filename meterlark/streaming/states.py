"""Operators that keep state between micro-batches: counter advance per file, and limit events per account and window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from meterlark.operators.limit_events import PASSED, SAME_INSTANCE_MS


def advance(total, was, last):
    """What a cumulative counter adds: see sources.rollouts.advanced, whose window form this must equal."""
    if total is None or was is None:
        return last
    if total == was:
        return None
    if all(a >= b for a, b in zip(total, was, strict=True)):
        return [a - b for a, b in zip(total, was, strict=True)]
    if total == last or all(a < b for a, b in zip(total, was, strict=True)):
        return total
    return last


def advanced(counts: DataFrame) -> DataFrame:
    """path, line_no, ts, usage of a stream of token counts (path, line_no, ts, total, last), whatever the cuts between batches."""

    def work(key, frames: Iterator[pd.DataFrame], state):
        was = list(state.get[0]) if state.exists and state.get[0] is not None else None
        rows = pd.concat(list(frames)).sort_values("line_no")
        out = []
        for r in rows.itertuples():
            total = None if r.total is None else [int(x) for x in r.total]
            last = None if r.last is None else [int(x) for x in r.last]
            usage = advance(total, was, last)
            was = total if total is not None else was
            if usage is not None and not (usage[0] == 0 and usage[2] == 0):
                out.append((key[0], r.line_no, r.ts, usage))
        state.update((None if was is None else [int(x) for x in was],))
        yield pd.DataFrame(out, columns=["path", "line_no", "ts", "usage"])

    return counts.groupBy("path").applyInPandasWithState(work, "path string, line_no long, ts long, usage array<long>", "total array<long>", "append", GroupStateTimeout.NoTimeout)


def limit_events(windows: DataFrame) -> DataFrame:
    """Events of a stream of windows (identity, kind, label, at, resets_at, utilization, minutes), each once per instance.

    A resumed window comes as its own row, with `closes` the reset of the reached instance it closes.  The state has the
    instances of one account's window: at most one per five hours, of the last eight days.
    """

    def work(key, frames: Iterator[pd.DataFrame], state):
        known = [[e, int(t), int(o)] for e, t, o in state.get[0]] if state.exists else []  # event, resets_at, open
        out = []
        for r in pd.concat(list(frames)).sort_values(["at", "resets_at"]).itertuples():
            if r.at >= r.resets_at:
                continue
            met = lambda event: any(e == event and abs(t - r.resets_at) < SAME_INSTANCE_MS for e, t, _ in known)  # noqa: B023, E731
            for event, hit in (("reached", r.utilization >= 1), ("passed_80", r.utilization >= PASSED and r.minutes == 10_080)):
                if hit and not met(event):
                    known.append([event, int(r.resets_at), 1])
                    out.append((*key, event, r.label, int(r.resets_at), int(r.at), None))
            if r.utilization < 1:
                closing = [x for x in known if x[0] == "reached" and x[2] and x[1] <= r.at]
                for x in closing:
                    x[2] = 0
                if closing and not met("resumed"):
                    known.append(["resumed", int(r.resets_at), 0])
                    out.append((*key, "resumed", r.label, int(r.resets_at), int(r.at), max(x[1] for x in closing)))
            known = [x for x in known if x[1] > r.at - 8 * 86_400_000]
        state.update(([tuple(x) for x in known],))
        frame = pd.DataFrame(out, columns=["identity", "window", "event", "label", "resets_at", "at", "closes"])
        yield frame.astype({"closes": "Int64"})

    return windows.groupBy("identity", "kind").applyInPandasWithState(work, "identity string, window string, event string, label string, resets_at long, at long, closes long", "known array<struct<event:string,resets_at:long,open:long>>", "append", GroupStateTimeout.NoTimeout)
