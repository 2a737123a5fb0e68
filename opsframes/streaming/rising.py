"""Runs of rising values per key on a stream: arbitrary keyed state with event-time timers.

The batch rule (:func:`opsframes.functions.windows.rising_run`) looks at a row
and the ``length - 1`` rows before it in its key's series. On a stream the
state of a key is those last values, and the samples that are not final yet.
A sample is final once the watermark has reached its time, since nothing
earlier can arrive any more: an event-time timer at the earliest of these times
takes all samples that are final by then, in time order. So order of arrival inside the watermark does not
matter, and state is bounded by the samples of the watermark's delay plus
``length - 1`` values a key.

Needs the RocksDB state store (:data:`STATE_STORE`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _processor(key_name: str, value: str, length: int, passed: list[str]):
    """The stateful processor. Defined in here so that it is sent to the workers whole, without this package."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    def number(x):
        return None if pd.isna(x) else float(x)

    def due(sample):
        """The millisecond at which the watermark makes a sample final."""
        return -(-sample[0] // 1000)

    class RisingRuns(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            # samples that wait for the watermark, and the last values of those it has passed
            self.waiting = handle.getValueState("waiting", "samples array<struct<at:long,value:double,row:array<double>>>")
            self.recent = handle.getValueState("recent", "values array<double>")

        def _held(self):
            return [tuple(x) for x in self.waiting.get()[0]] if self.waiting.exists() else []

        def handleInputRows(self, key, rows, timerValues):
            held = self._held()
            before = min((due(x) for x in held), default=None)
            for batch in rows:
                for at, v, *row in zip(batch["at_micros"], batch[value], *(batch[c] for c in passed)):
                    held.append((int(at), number(v), [number(x) for x in row]))
            self.waiting.update((held,))
            first = min(due(x) for x in held)
            if before is None or first < before:
                self.handle.registerTimer(first)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            reached = timerValues.getCurrentWatermarkInMs()
            held = self._held()
            final = sorted((x for x in held if due(x) <= reached), key=lambda x: (x[0], x[1] is not None, x[1] or 0.0))
            if not final:  # another timer of this batch has taken them
                return
            recent = list(self.recent.get()[0]) if self.recent.exists() else []
            out = []
            for at, v, row in final:
                chain = [*recent, v][-length:]
                rising = len(chain) == length and None not in chain and all(a < b for a, b in zip(chain, chain[1:]))
                out.append((*key, at, v, rising, *row))
                recent = chain[1 - length:] if length > 1 else []
            self.recent.update((recent,))
            left = [x for x in held if due(x) > reached]
            self.waiting.update((left,))
            if left:
                self.handle.registerTimer(min(map(due, left)))
            yield pd.DataFrame(out, columns=[key_name, "at_micros", value, "rising", *passed])

        def close(self):
            pass

    return RisingRuns()


def rising_stream(samples: DataFrame, key: str, value: str, length: int, passed: tuple[str, ...] = (),
                  time: str = "event_time") -> DataFrame:
    """``samples`` (with a watermark on ``time``) as (key, ``time``, value, rising, passed columns), in append mode.

    Same rows and flags as the batch ``rising_run`` over all samples that are
    final. Null keys and times take no part; a null value breaks a run. Samples
    of one time are taken in order of their value. ``passed`` columns are doubles.
    """
    passed = list(passed)
    fed = (samples.where(F.col(key).isNotNull() & F.col(time).isNotNull())
           .withColumn("at_micros", F.unix_micros(time)).select(key, time, "at_micros", value, *passed))
    kind = fed.schema[key].dataType.simpleString()
    fields = ", ".join([f"{key} {kind}", "at_micros long", f"{value} double", "rising boolean", *[f"{c} double" for c in passed]])
    flagged = fed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_processor(key, value, length, passed), outputStructType=fields, outputMode="Append", timeMode="EventTime")
    return flagged.withColumn(time, F.timestamp_micros("at_micros")).drop("at_micros")
