"""Evidence as a stream: each view keeps its observations as state, and posteriors follow every change.

The state of a view is what its latest events say by event time, so events may
come in any order and in any micro-batches: of each variable the latest action
counts, and nothing older than the latest ``clear_all``.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from factorloom.model import Network
from factorloom.operators.inference import evidence_cases, posterior_rows
from factorloom.plans.junction import CompiledNetwork, compilations
from factorloom.plans.lineage import shared_folder

EVENT_SCHEMA = "view_id string, ts timestamp, action string, variable string, value string"
OUTPUT = "view_id string, variable string, outcome string, p double, evidence string, as_of timestamp"
#: Of events at the same time the last of these counts; of equal actions the greatest value.
ACTIONS = {"clear_all": 0, "clear": 1, "set": 2}
EVERYTHING = ""
#: A network of more variables keeps its views' state in a processor, not in a column a variable.
MAX_STATE_COLUMNS = 100
#: Bytes of events in a row group of a replayed file, so that several tasks read it.
ROW_GROUP = 8 << 20


class LatestEvidence(StatefulProcessor):
    """State of a view: by variable (``EVERYTHING`` for all) the time, rank and value of its latest action."""

    def __init__(self, net: Network, wanted: list[str], idle_ms: int | None):
        self.net, self.wanted, self.idle_ms = net, wanted, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "variable string", "ts long, rank int, value string")
        self.until = handle.getValueState("until", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a call of the state is a round trip to the JVM: the rows are reduced first
        kernel, newest, latest = compilations().get(self.net), None, {}
        for some in rows:
            ts = some["ts"].astype("datetime64[us]").astype("int64").tolist()
            for at, action, variable, value in zip(ts, some["action"], some["variable"], some["value"], strict=True):
                newest = at if newest is None else max(newest, at)
                if action == "clear_all":
                    variable, value = EVERYTHING, ""
                elif action == "clear" and variable in kernel.outcomes:
                    value = ""
                elif action != "set" or value not in kernel.outcomes.get(variable, ()):
                    continue
                one = (at, ACTIONS[action], value)
                if variable not in latest or one > latest[variable]:
                    latest[variable] = one
        known = {k[0]: tuple(v) for k, v in self.latest.iterator()}
        for variable, one in latest.items():
            if variable not in known or one > known[variable]:
                known[variable] = one
                self.latest.updateValue((variable,), one)
        since = known.pop(EVERYTHING, (None, 0, ""))
        seen = {v: o for v, (at, rank, o) in known.items() if rank == ACTIONS["set"] and (since[0] is None or at >= since[0])}
        newest = max(newest, self.until.get()[0]) if self.until.exists() else newest
        self.until.update((newest,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest // 1000 + self.idle_ms)
        yield self._posteriors(key[0], seen, newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is past a view's last event by the idle time: it starts anew."""
        self.latest.clear()
        self.until.clear()
        yield self._posteriors(key[0], {}, None)

    def _posteriors(self, view: str, seen: dict[str, str], newest: int | None) -> pd.DataFrame:
        kernel = compilations().get(self.net)
        found, _ = kernel.infer(seen, wanted=self.wanted)
        as_of = pd.NaT if newest is None else pd.Timestamp(newest, unit="us")
        text = json.dumps(seen, sort_keys=True)
        rows = [(view, v, o, float(found[v][i]), text, as_of) for v in self.wanted for i, o in enumerate(kernel.outcomes[v])]
        return pd.DataFrame(rows, columns=["view_id", "variable", "outcome", "p", "evidence", "as_of"]).astype({"as_of": "datetime64[ns]"})

    def close(self) -> None:
        pass


def _view_states(events: DataFrame, net: Network) -> DataFrame:
    """What is known of each view, as a streaming aggregate: ``as_of`` in microseconds and in ``o0``, ``o1``, ... the outcome set for each variable.

    The latest action of a variable is a maximum, so Spark reduces a batch
    before it exchanges it and keeps one state row a view.
    """
    action, variable, value = F.col("action"), F.col("variable"), F.col("value")
    rank = F.when(action == "set", ACTIONS["set"]).otherwise(ACTIONS["clear"])
    one = F.struct(F.col("ts").alias("ts"), rank.alias("rank"), F.when(action == "set", value).otherwise("").alias("value"))
    latest = []
    for k, v in enumerate(net.variables.values()):
        counts = (variable == v.name) & ((action == "clear") | ((action == "set") & value.isin(*v.outcomes)))
        latest.append(F.max(F.when(counts, one)).alias(f"s{k}"))
    state = events.groupBy("view_id").agg(F.max("ts").alias("as_of"), F.max(F.when(action == "clear_all", F.col("ts"))).alias("since"), *latest)
    since = F.col("since")
    outcomes = []
    for k in range(len(net.variables)):
        stands = (F.col(f"s{k}.rank") == ACTIONS["set"]) & (since.isNull() | (F.col(f"s{k}.ts") >= since))
        outcomes.append(F.when(stands, F.col(f"s{k}.value")).alias(f"o{k}"))
    return state.select("view_id", F.unix_micros(F.col("as_of").cast("timestamp")).alias("as_of"), *outcomes)


def _view_posteriors(shared, wanted: list[str]):
    """Posterior rows of a batch of view states; each distinct evidence is solved and written out once."""

    def run(batches):
        net: CompiledNetwork = shared.value
        for batch in batches:
            if not len(batch):
                continue
            seen = batch.iloc[:, 2:].set_axis(net.names, axis=1)
            weights, which = evidence_cases(seen, net.names, net.outcomes)
            first = np.unique(which, return_index=True)[1]
            texts = [json.dumps({v: o for v, o in zip(net.names, row, strict=True) if isinstance(o, str)}, sort_keys=True) for row in seen.iloc[first].itertuples(index=False, name=None)]
            keys = batch[["view_id", "as_of"]].assign(evidence=np.array(texts, object)[which])
            found, _ = net.posteriors(weights, len(first), wanted)
            for rows in posterior_rows(keys, list(keys.columns), wanted, net.outcomes, found, which):
                yield rows[["view_id", "variable", "outcome", "p", "evidence", "as_of"]]

    return run


def posterior_stream(spark: SparkSession, events: DataFrame, net: Network, wanted: list[str], idle: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Posterior rows of each view after its new events, by event time.

    Actions are ``set`` (variable, value), ``clear`` (one variable) and
    ``clear_all``; unknown names and outcomes are ignored.  A late ``set`` does
    not overwrite a newer one, in whatever micro-batch it comes.  State is one
    entry a variable and view, in a streaming aggregate.  With ``idle`` (an
    interval like '30 minutes') a view is forgotten once the watermark, ``delay``
    behind the newest event, is past its last event by that much; events older
    than the watermark are then dropped.  That takes timers, so a processor keeps
    the state, as it does for more than ``MAX_STATE_COLUMNS`` variables.  Rows
    without a time or a view are dropped.

    The network travels with the tasks (its tables are bounded by the model).
    The state lives in RocksDB, which this sets for the session's streams.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = events.where("ts is not null and view_id is not null").select("view_id", "ts", "action", "variable", "value")
    if idle is None and len(net.variables) <= MAX_STATE_COLUMNS:
        shared = spark.sparkContext.broadcast(compilations().get(net))
        found = _view_states(events, net).mapInPandas(_view_posteriors(shared, wanted), OUTPUT.replace("as_of timestamp", "as_of long"))
        return found.withColumn("as_of", F.timestamp_micros("as_of"))
    idle_ms = None
    if idle is not None:
        idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
        events = events.withWatermark("ts", delay)
    return events.groupBy("view_id").transformWithStateInPandas(LatestEvidence(net, wanted, idle_ms), OUTPUT, "update", "EventTime" if idle else "None")


def replayed(spark: SparkSession, events: DataFrame, net: Network, wanted: list[str], files: int = 6, files_per_batch: int = 2) -> DataFrame:
    """The last posterior rows of each view after ``events`` (as ``EVENT_SCHEMA``) went through the stream in shuffled order.

    The events are dealt to files by a hash and read back as a stream, a few
    files a micro-batch; what each batch gives is written to the shared folder.
    There are ``files``, or more where more cores can write them; a micro-batch
    takes ``files_per_batch`` in ``files`` of them, so their number stays.
    """
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    events.select("view_id", "ts", "action", "variable", "value").repartition(max(files, spark.sparkContext.defaultParallelism), F.xxhash64("view_id", "ts", "value")).write.option("parquet.block.size", ROW_GROUP).parquet(f"{root}/events")
    written = len(spark.read.schema(EVENT_SCHEMA).parquet(f"{root}/events").inputFiles())
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", math.ceil(written * files_per_batch / files)).parquet(f"{root}/events")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    out = posterior_stream(spark, stream, net, wanted)
    run = out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.schema(f"{OUTPUT}, batch long").option("recursiveFileLookup", True).parquet(f"{root}/out")
    last = done.groupBy("view_id", "variable", "outcome").agg(F.max_by(F.struct("p", "evidence", "as_of"), "batch").alias("x"))
    return last.select("view_id", "variable", "outcome", "x.p", "x.evidence", "x.as_of")
