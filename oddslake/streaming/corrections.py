"""Outcomes that stand only once no correction has come for a while, by timers on event time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What becomes of an outcome: it has stood for the delay, or a settled one has been corrected.
SETTLED, WITHDRAWN = "settled", "withdrawn"


def settled_after(stream: DataFrame, key: str, time: str, outcome: str, delay: timedelta, late: str) -> DataFrame:
    """(key, status, outcome, since, at): outcomes as they settle, and those that a later reading takes back.

    A reading is a row of ``stream``. An outcome counts from the first of the readings in a
    row that say it (since), and settles ``delay`` after that (at), when either a later
    reading or the watermark, ``late`` behind the newest reading of all, has come so far. A
    reading that says otherwise before that starts the delay anew and nothing is settled; one
    that comes afterwards withdraws the settled outcome at its time. Readings of one time go
    by outcome. Readings before the newest one of their key, without a time or without an
    outcome are passed over. State is one row a key; a key whose outcome has settled is held
    for corrections.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    wait = int(delay.total_seconds() * 1_000_000)
    columns = [key, "status", outcome, "since", "at"]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = max(0, state.getCurrentWatermarkMs()) * 1000
        said, since, newest, settled = state.get if state.exists else (None, 0, -(2**62), False)
        out: list[tuple] = []

        def settle(upto: int) -> None:
            nonlocal settled
            if said is not None and not settled and since + wait <= upto:
                settled = True
                out.append((group[0], SETTLED, said, since, since + wait))

        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).dropna(subset=["_micros", outcome]).sort_values(["_micros", outcome])
            for micros, says in zip(rows["_micros"].astype("int64").tolist(), rows[outcome].tolist(), strict=True):
                if micros < newest:
                    continue
                settle(micros)
                newest = micros
                if says != said:
                    if settled:
                        out.append((group[0], WITHDRAWN, said, since, micros))
                    said, since, settled = says, micros, False
        settle(now)
        if said is not None:
            state.update((said, since, newest, settled))
            if not settled:
                due = -(-(since + wait) // 1000)
                state.setTimeoutTimestamp(max(due - 1, now // 1000 + 1))  # fires once the watermark is past it
        yield pd.DataFrame(out, columns=columns)

    schema = f"`{key}` {kinds[key]}, status string, `{outcome}` string, since long, at long"
    held = "said string, since long, newest long, settled boolean"
    rows = stream.select(key, time, F.col(outcome).cast("string").alias(outcome), F.unix_micros(time).alias("_micros")).withWatermark(time, late)
    out = rows.groupBy(key).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, "status", outcome, F.timestamp_micros("since").alias("since"), F.timestamp_micros("at").alias("at"))
