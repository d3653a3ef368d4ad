"""Streaming forms of the stateful operators. Each gives what its batch form gives over the same rows.

State is kept per key and bounded: a rate limit keeps the times within its window, a fact state one row per field, a
line buffer the unfinished line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, at: str, window: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; rows later than `late` behind the newest are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def once_within(events: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Repeats of a key within the time that late rows may take are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def rate_limit(events: DataFrame, key: str, event_id: str, at: str, seconds: int, limit: int) -> DataFrame:
    """(key, event_id, in_window, refused) of each event: the events of its key later than `seconds` before it, itself included, up to
    what has arrived; refused beyond the limit. Within a batch rows are taken in the order of their times."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["_t", event_id], ignore_index=True)
        out = []
        for t, e in zip(rows["_t"], rows[event_id]):
            times = [x for x in times if x > t - seconds * 1_000_000] + [t]
            out.append((k[0], e, len([x for x in times if x <= t]), len(times) > limit))
        state.update((times,))
        yield pd.DataFrame(out, columns=[key, event_id, "in_window", "refused"])

    timed = events.select(key, event_id, F.unix_micros(at).alias("_t"))
    return timed.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{event_id}` {kinds[event_id]}, in_window int, refused boolean", "times array<bigint>", "update", GroupStateTimeout.NoTimeout)


def fact_state(events: DataFrame, entity: str, field: str, status: str, order: str, value: str) -> DataFrame:
    """The state of each field as rows arrive: a stated row replaces any earlier one, an inferred row only an inferred one."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else None
        for row in pd.concat(list(batches)).itertuples(index=False):
            if row.s in ("stated", "inferred"):
                new = (row.s == "stated", int(row.o), row.v)
                best = new if best is None or new[:2] > best[:2] else best
        if best is not None:
            state.update(best)
            yield pd.DataFrame([(k[0], k[1], "stated" if best[0] else "inferred", best[2])], columns=[entity, field, "status", "value"])

    plain = events.select(entity, field, F.col(status).alias("s"), F.col(order).cast("bigint").alias("o"), F.col(value).cast("string").alias("v"))
    return plain.groupBy(entity, field).applyInPandasWithState(step, f"`{entity}` {kinds[entity]}, `{field}` {kinds[field]}, status string, value string", "stated boolean, o bigint, v string", "update", GroupStateTimeout.NoTimeout)


def line_buffer(deltas: DataFrame, key: str, seq: str, delta: str) -> DataFrame:
    """(key, line) of every line that is finished; the rest waits for the next delta. Deltas of a key arrive in order of seq."""
    kinds = {f.name: f.dataType.simpleString() for f in deltas.schema.fields}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        for piece in pd.concat(list(batches)).sort_values("s")["d"]:
            held += piece or ""
        *done, rest = held.split("\n")
        state.update((rest,))
        yield pd.DataFrame([(k[0], line) for line in done], columns=[key, "line"])

    plain = deltas.select(key, F.col(seq).alias("s"), F.col(delta).alias("d"))
    return plain.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, line string", "held string", "append", GroupStateTimeout.NoTimeout)
