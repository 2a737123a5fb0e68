"""Alert status from operator actions, both live.

A stream-stream left outer join on the alert id with a time bound (an action
counts if it comes within ``within`` after its alert), then the latest action
per alert. The bound lets both sides' state go: an alert is held until no
action that counts can arrive any more, an action until its alert can't. An
alert nobody acts on comes out then too, with its own status. The query's
watermark is the lesser of both streams' (:data:`.alerts.POLICY`), so a
lagging stream of actions delays alerts rather than lose actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import event_time, wall_clock
from ..operators.alerts import with_last_action
from ..sources.tables import alert_actions_from_events, alerts_from_events
from . import sinks
from .alerts import POLICY

_ALERT = ["alert_id", "type", "severity", "priority", "description", "status"]


def alert_action_stream(alerts: DataFrame, actions: DataFrame, within: str = "2 hours", watermark: str = "1 hour") -> DataFrame:
    """Streaming :func:`~opsframes.operators.alerts.apply_alert_actions` with its ``within`` bound, in append mode.

    Same rows as the batch function for every alert that is older than
    ``within`` at the watermark. Rows without a time take no part.
    """
    raised = (alerts.select(*_ALERT, event_time("timestamp").alias("raised"))
              .withWatermark("raised", watermark))
    acted = (actions.select(F.col("alert_id").alias("of_alert"), "new_status", event_time("acted").alias("at"))
             .withWatermark("at", watermark))
    bound = F.expr(f"INTERVAL {within}")
    joined = raised.join(acted, (F.col("alert_id") == F.col("of_alert")) & (F.col("at") >= F.col("raised"))
                         & (F.col("at") <= F.col("raised") + bound), "left_outer")
    last = (joined.withColumn("acted", wall_clock("at")).groupBy("raised", *_ALERT)
            .agg(F.max(F.when(F.col("acted").isNotNull(), F.struct("acted", "new_status"))).alias("last")))
    return with_last_action(last.withColumn("timestamp", wall_clock("raised"))
                            .withColumns({"new_status": F.col("last.new_status"), "acted": F.col("last.acted")}))


def run_alert_actions(spark: SparkSession, source_dir: str, within: str = "2 hours", watermark: str = "1 hour",
                      files_per_trigger: int | None = None, trigger: dict | None = None, glob: str = "events*.parquet",
                      paths: tuple[str, str] | None = None) -> DataFrame:
    """Run both streams over the event files in ``source_dir`` and read the alerts decided.

    ``paths`` (output, checkpoint) of an earlier run resume it.
    """
    def events() -> DataFrame:
        return sinks.read_event_stream(spark, source_dir, glob, files_per_trigger)

    out, checkpoint = paths or sinks.fresh_paths(spark, "stream_alert_actions")
    with sinks.settings(spark, POLICY):
        decided = alert_action_stream(alerts_from_events(events()), alert_actions_from_events(events()), within, watermark)
        sinks.run_to_completion(sinks.to_files(decided, out, checkpoint, trigger))
    return spark.read.parquet(out)
