"""State of many keys in one group: Spark calls Python once for a bucket of keys, not once for each key.

Such a call costs some milliseconds of frames and state whatever it holds, which is most of the time of a stream whose
keys have a few events in a batch.  Keys are folded one by one as before, each with a deadline of its own; Spark's
timeout of a bucket is the earliest of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 256  # part of the checkpoint: a stream that goes on needs the number that it began with

# (key, its rows in order or None if its deadline is over, what is held or None, watermark in ms, rows to emit) -> (held, deadline in ms) or None
Step = Callable[[tuple, "list[tuple] | None", object, int, list], "tuple[object, int] | None"]


def fold_keys(rows: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], step: Step, schema: str, timeout: bool = True) -> DataFrame:
    """What ``step`` emits, key by key and batch by batch.

    ``rows`` has created_at (with a watermark, if there is a timeout), ``us`` (its microseconds), id, keys and values; those
    whose ``us`` is null only move the watermark on.  Rows of a key are handed over as (us, id, values) by time and id, where
    ids of digits are ordered as numbers.  What is held must be good for JSON.  As in Spark, a key is not timed out by a
    batch that has rows of it.
    """
    columns, sent = [c.split()[0] for c in schema.split(", ")], ["us", "id", *values]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = {tuple(key): (held, deadline) for key, held, deadline in json.loads(state.get[0])} if state.exists else {}
        mark = state.getCurrentWatermarkMs() if timeout else 0
        out: list[tuple] = []
        found: dict[tuple, list[tuple]] = {}
        if not state.hasTimedOut:
            frame = pd.concat(batches)
            frame = frame[frame["us"].notna()].astype({"us": "int64"})
            for key, row in zip(zip(*[frame[c].tolist() for c in keys]), zip(*[frame[c].tolist() for c in sent])):
                found.setdefault(key, []).append(row)
        over = [k for k, (_, deadline) in table.items() if deadline < mark and k not in found] if timeout else []
        for key in (*found, *over):
            mine = found.get(key)
            if mine:
                mine.sort(key=_place)
            kept = step(key, mine, table.get(key, (None, 0))[0], mark, out)
            if kept is None:
                table.pop(key, None)
            else:
                table[key] = kept
        if table:
            state.update((json.dumps([(k, *kept) for k, kept in table.items()]),))
            if timeout:
                state.setTimeoutTimestamp(min(deadline for _, deadline in table.values()))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")
    dealt = rows.select("created_at", bucket, *dict.fromkeys((*keys, "us", "id", *values))).groupBy("bucket")
    kind = GroupStateTimeout.EventTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return dealt.applyInPandasWithState(run, schema, "held string", "append", kind)


def _place(row: tuple) -> tuple:
    return row[0], len(row[1] or ""), row[1] or ""
