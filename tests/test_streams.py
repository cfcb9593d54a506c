"""Evidence streams: what they keep as state, and that both ways to keep it say the same."""

import datetime
import random

import pandas as pd

from factorloom.catalog import chain_network
from factorloom.fixtures import ASIA
from factorloom.streaming import evidence
from factorloom.streaming.evidence import EVENT_SCHEMA, LatestEvidence, posterior_stream, replayed

START = datetime.datetime(2024, 1, 1)


def drawn(draw: random.Random, views: int, events: int, names: list[str], values: list[str], seconds: int) -> list[tuple]:
    """Events in no order, some at the same second, with unknown names, values and actions and nulls among them."""
    action = ["set"] * 6 + ["clear", "clear", "clear_all", "other", None]
    return [
        (f"v{draw.randrange(views)}", START + datetime.timedelta(seconds=draw.randrange(seconds), microseconds=draw.randrange(2)), draw.choice(action), draw.choice([*names, "nobody", None]), draw.choice([*values, "maybe", None]))
        for _ in range(events)
    ]


class CountedState:
    """A state handle in memory that counts what is asked of it."""

    def __init__(self):
        self.calls, self.map, self.value = 0, {}, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return ValueOf(self)

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def iterator(self):
        self.calls += 1
        return iter(self.map.items())


class ValueOf:
    def __init__(self, handle):
        self.handle = handle

    def exists(self):
        self.handle.calls += 1
        return self.handle.value is not None

    def get(self):
        self.handle.calls += 1
        return self.handle.value

    def update(self, value):
        self.handle.calls += 1
        self.handle.value = value


def test_processor_asks_for_state_by_variable_and_not_by_event():
    handle = CountedState()
    processor = LatestEvidence(ASIA, ["lung"], None)
    processor.init(handle)
    rows = drawn(random.Random(3), 1, 4000, ["smoke", "xray", "asia"], ["yes", "no"], 100)
    frames = [pd.DataFrame(rows[k : k + 1000], columns=["view_id", "ts", "action", "variable", "value"]) for k in range(0, 4000, 1000)]
    got = list(processor.handleInputRows(("v0",), iter(frames), None))
    assert len(got) == 1 and handle.calls <= 10
    again = list(processor.handleInputRows(("v0",), iter(frames), None))
    assert again[0].equals(got[0]) and handle.calls <= 20


def test_views_that_are_not_forgotten_are_a_streaming_aggregate(spark, tmp_path):
    """Spark reduces a batch's events before their exchange; no event goes to Python."""
    rows = drawn(random.Random(4), 3, 500, ["smoke", "xray"], ["yes", "no"], 100)
    spark.createDataFrame(rows, EVENT_SCHEMA).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    run = posterior_stream(spark, events, ASIA, ["lung"]).writeStream.format("memory").queryName("aggregate").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        state = next(p for p in run.recentProgress if p["numInputRows"])["stateOperators"]
    finally:
        run.stop()
    assert [(s["operatorName"], s["numRowsTotal"]) for s in state] == [("stateStoreSave", 3)]
    assert spark.table("aggregate").count() == 6


def test_both_ways_to_keep_state_say_the_same(spark, monkeypatch):
    """Shuffled events, ties and unknown names: the aggregate gives what the processor gives, here and on a longer chain."""
    chain = chain_network(8)
    values = list(chain.variables["v0"].outcomes)
    for net, names, said, wanted in ((ASIA, ["smoke", "xray", "asia"], ["yes", "no"], ["lung", "bronc"]), (chain, list(chain.variables), values, ["v3"])):
        rows = drawn(random.Random(5), 9, 1500, names, said, 40)
        events = spark.createDataFrame([*rows, (None, START, "set", names[0], said[0]), ("v1", None, "set", names[0], said[0]), ("quiet", START, "other", None, None)], EVENT_SCHEMA)
        found = []
        for columns in (evidence.MAX_STATE_COLUMNS, 0):
            monkeypatch.setattr(evidence, "MAX_STATE_COLUMNS", columns)
            got = replayed(spark, events, net, wanted).collect()
            found.append(sorted((r["view_id"], r["variable"], r["outcome"], round(r["p"], 9), r["evidence"], r["as_of"]) for r in got))
        monkeypatch.undo()
        assert found[0] == found[1] and len({r[0] for r in found[0]}) == 10
        assert len({r[4] for r in found[0]}) > 5 and ("quiet", START, "{}") in {(r[0], r[5], r[4]) for r in found[0]}


def test_replays_take_the_batches_they_were_given(spark, monkeypatch):
    """However many files the events fill, ``files / files_per_batch`` micro-batches read them; no events are no rows."""
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: 12))
    events = spark.createDataFrame(drawn(random.Random(6), 5, 600, ["smoke", "xray"], ["yes", "no"], 60), EVENT_SCHEMA)
    got = replayed(spark, events, ASIA, ["lung"])
    assert got.count() == 10
    root = got.inputFiles()[0].split("/out/")[0]
    assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) == 3
    assert len(spark.read.parquet(f"{root}/events").inputFiles()) == 12
    assert replayed(spark, events.limit(0), ASIA, ["lung"]).count() == 0
