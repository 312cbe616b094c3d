"""Responses that are sent again on a stream: the last one counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Keys share a call and a state by their hash: a call of its own for every key costs milliseconds.
BUCKETS = 8192


def changes(scored: DataFrame, key: Sequence[str] = ("question_id", "model"), by: Sequence[str] = ("model",), order: str = "sent",
            keep_for: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of scored responses as changes of counts: ``by``, ``correct``, ``total``.

    State holds the last response of each key.  A response that replaces another takes the
    earlier one's counts back; one that is older than the state, or the same again, changes
    nothing.  So sums over the changes are those over the last responses, in whatever order
    files arrive.  ``order`` is compared as text.  With ``keep_for`` (as ``"7 days"``) a key without
    responses for that long is forgotten and counts as new when it comes back; such a stream
    runs until it is stopped.  By default keys are kept.

    Keys are dealt to ``buckets`` by their hash.  A batch reads and writes the state of the buckets
    it touches, so their number is to grow with that of the keys: some thousand keys each are well.
    """
    fields = {f.name: f.dataType for f in scored.schema.fields}
    groups = [c for c in by if c not in key]
    out = ", ".join([f"`_by{i}` string" for i in range(len(by))] + ["correct long", "total long"])
    # Values travel as text: pandas would turn whole numbers beside nulls into doubles.
    held_columns = [*(f"_key{i}" for i in range(len(key))), "_order", "_predicted", "_correct", *(f"_group{i}" for i in range(len(groups)))]
    kinds = {"_correct": "boolean"}
    state = ", ".join([f"`{c}` array<{kinds.get(c, 'string')}>" for c in held_columns] + ["_seen array<long>"])
    wait = _milliseconds(keep_for)
    width = len(key)
    places = [list(key).index(c) if c in key else width + 3 + groups.index(c) for c in by]

    def update(_: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        at = held.getCurrentProcessingTimeMs() if wait else 0
        *old_columns, seen_at = held.get if held.exists else ([],) * (len(held_columns) + 1)
        rows = list(zip(*old_columns))
        old = {r[:width]: r[width:] for r in rows}
        seen = dict(zip((r[:width] for r in rows), seen_at))
        now = dict(old)
        if not held.hasTimedOut:
            for frame in frames:
                for row in zip(*(frame[c].tolist() for c in held_columns)):
                    name, new = row[:width], row[width:]
                    last = now.get(name)
                    if last is None or (str(new[0]), str(new[1])) > (str(last[0]), str(last[1])):
                        now[name] = new
                    seen[name] = at
        correct, total = Counter(), Counter()
        for name, new in now.items():
            last = old.get(name)
            if new != last:
                for values, sign in ((last, -1), (new, 1)):
                    if values is not None:
                        whole = name + values
                        place = tuple(whole[i] for i in places)
                        correct[place] += sign * values[2]
                        total[place] += sign
        if wait:
            now = {name: values for name, values in now.items() if not held.hasTimedOut or seen[name] + wait > at}
            if not now:
                held.remove()
                return
            held.setTimeoutDuration(max(1, min(seen[name] for name in now) + wait - at))
        if wait or now != old:
            held.update((*(list(c) for c in zip(*(name + values for name, values in now.items()))), [seen[name] for name in now]))
        if rows := [(*place, correct[place], n) for place, n in total.items() if n or correct[place]]:
            yield pd.DataFrame(rows, columns=[*(f"_by{i}" for i in range(len(by))), "correct", "total"])

    slim = scored.select(*[_as_text(F.col(c), fields[c]).alias(f"_key{i}") for i, c in enumerate(key)],
                         *[_as_text(F.col(c), fields[c]).alias(f"_group{i}") for i, c in enumerate(groups)],
                         F.col(order).cast("string").alias("_order"), F.col("predicted_answer").alias("_predicted"),
                         F.coalesce("is_correct", F.lit(False)).alias("_correct"))
    bucket = F.pmod(F.xxhash64(*[f"_key{i}" for i in range(width)]), F.lit(buckets)).alias("_bucket")
    found = slim.select(bucket, "*").groupBy("_bucket").applyInPandasWithState(
        update, out, state, "append", "ProcessingTimeTimeout" if wait else "NoTimeout")
    return found.select(*[_from_text(F.col(f"_by{i}"), fields[c]).alias(c) for i, c in enumerate(by)], "correct", "total")


def _as_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def _from_text(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    return F.from_json(text, kind) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else text.cast(kind)


def _milliseconds(text: str | None) -> int:
    if text is None:
        return 0
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    number, unit = text.split()
    return int(float(number) * units[unit.rstrip("s")] * 1000)
