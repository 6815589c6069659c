"""Sessions as streaming state: late, repeated and re-ordered events, restarts, and sessions that end."""

import datetime as dt
import random

from lodestone.streaming import sessions as S

T0 = dt.datetime(2024, 1, 1, 12)


def event(session, i, minute, kind, text):
    return (session, i, T0 + dt.timedelta(minutes=minute), kind, text)


def run(spark, tmp_path, name, batches, **options):
    """Each batch a file, each file a start of the query on the same checkpoint; the last row of each session."""
    source, latest = tmp_path / name, {}
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(S.EVENTS).json(str(source))
        got = []
        query = S.session_states(stream, **options).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        for r in got:
            latest[r.session_id] = r
    return latest


def test_order_and_repeats_do_not_matter(spark, tmp_path):
    events = [event("a", 1, 0, "ask", "birds"), event("a", 2, 1, "pos", "t1"), event("a", 3, 2, "neg", "t2"), event("a", 4, 3, "ask", "rocks"), event("a", 5, 4, "pos", "t3"), event("a", 6, 5, "neg", "t3"), event("a", 7, 6, "pos", "t4"), event("a", 8, 6, "ask", "rocks"), event("a", 9, 7, "none", "t4"), event("b", 1, 3, "pos", "x")]
    want = {"a": ("rocks", [], ["t3"]), "b": (None, ["x"], [])}
    rng = random.Random(2)
    mixed = events + rng.sample(events, 5)
    rng.shuffle(mixed)
    for name, batches in (("in-order", [events[:4], events[4:]]), ("mixed", [mixed[:9], mixed[9:]])):
        got = run(spark, tmp_path, name, batches)
        assert {k: (r.query, r.positive_ids, r.negative_ids) for k, r in got.items()} == want and not any(r.ended for r in got.values())


def test_quiet_sessions_end_and_too_late_events_are_dropped(spark, tmp_path):
    batches = [[event("a", 1, 0, "ask", "birds"), event("a", 2, 1, "pos", "t1")], [event("b", 1, 300, "ask", "fish")], [event("a", 3, 2, "neg", "t1"), event("b", 2, 301, "pos", "t9")]]
    got = run(spark, tmp_path, "quiet", batches)
    assert got["a"].ended and (got["a"].query, got["a"].positive_ids, got["a"].negative_ids) == ("birds", ["t1"], [])
    assert not got["b"].ended and got["b"].positive_ids == ["t9"]


def test_standing_is_the_fold_of_a_session():
    assert S.standing([], {}) == (None, [], [])
    assert S.standing([(1, 1, "q"), (5, 1, "q")], {"x": (3, 1, "pos")}) == ("q", ["x"], [])
    assert S.standing([(1, 1, "q"), (4, 1, "r"), (5, 1, "q")], {"x": (3, 1, "pos"), "y": (5, 2, "neg"), "z": (6, 1, "none")}) == ("q", [], ["y"])


def test_a_batch_reads_and_writes_a_session_once():
    """However many events it has."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, what):
            def call(*given):
                calls.append((self.name, what))
                if what == "exists":
                    return self.value is not None
                if what == "get":
                    return self.value if self.name == "last" else iter(self.value or ())
                if what in ("put", "update"):
                    self.value = given[0]
            return call

    class Handle:
        getListState = getValueState = getMapState = lambda self, name, *schema: State(name)
        listTimers = lambda self: iter(())
        registerTimer = deleteTimer = lambda self, at: calls.append(("timer", at))

    s = S.Sessions(1000)
    s.init(Handle())
    for batch in range(2):
        calls.clear()
        rows = pd.DataFrame([(i, pd.Timestamp(T0) + pd.Timedelta(minutes=i), "pos", f"t{i % 9}") for i in range(batch * 500, batch * 500 + 500)], columns=["event_id", "ts", "kind", "text"])
        (row,) = s.handleInputRows(("a",), iter([rows]), None)
        assert len(calls) <= 9 and row.n_events[0] == 500 * (batch + 1) and len(row.positive_ids[0]) == 9
