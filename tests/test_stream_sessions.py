"""Sessions with state and timers against batch operators and hand-made cases."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from skein.operators import trace
from skein.plans import catalog
from skein.streaming import sessions

SCHEMA = "session string, at long, ts timestamp, tool string, scope string, rule string, reply string, note string"
START = datetime(2026, 1, 1)


def stream_of(spark, folder, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def steps(session: str, first: int, *calls: tuple) -> list[tuple]:
    return [(session, first + i, START + timedelta(minutes=first + i), tool, scope, rule, reply, f"{first + i}. {tool}") for i, (tool, scope, rule, reply) in enumerate(calls)]


def test_approvals_last_and_sessions_expire(spark, tmp_path):
    a = steps("a", 0, ("sh", "git", "ask", "no"), ("sh", "git", "ask", "always"), ("sh", "git", "ask", None), ("sh", "rm", "ask", "allow"), ("web", "x", "deny", None), ("web", "x", "allow", None))
    later = steps("a", 6, *[("sh", "git", "ask", None)] * 15)
    far = [("z", 0, START + timedelta(days=9), "t", "s", "allow", None, "far")]
    after = [("a", 100, START + timedelta(days=9, minutes=1), "sh", "git", "ask", "no", "new session"), ("z", 1, START + timedelta(days=9), "t", "s", "allow", None, "far")]
    for batch in (a, later, far, after):
        out = sessions.land(sessions.follow(stream_of(spark, str(tmp_path / "in"), batch)), str(tmp_path / "out"))
    found = out.collect()
    rows = {(r["session"], r["at"]): (r["decision"], r["repeats"]) for r in found if r["kind"] == "step"}
    assert [rows["a", i] for i in range(6)] == [("ask_no", 0), ("ask_always", 1), ("allow", 2), ("ask_yes", 0), ("deny", 0), ("allow", 1)]
    assert [rows["a", i] for i in range(6, 21)] == [("allow", i) for i in range(15)]
    assert rows["a", 100] == ("ask_no", 0)  # approvals ended with the session
    closed = [r for r in found if r["kind"] == "closed"]
    assert [(r["session"], r["history"]) for r in closed] == [("a", [f"{i}. sh" for i in range(21 - trace.HISTORY, 21)])]


def test_state_is_empty_after_expiry(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sessions.land(sessions.follow(stream_of(spark, source, steps("a", 0, ("t", "s", "ask", "always")), steps("b", 5, ("t", "s", "ask", "no")))), out)
    left = lambda name: {r["key"]["session"] for r in spark.read.format("statestore").option("stateVarName", name).load(f"{out}/checkpoint").select("key").collect()}
    assert left("last") == {"a", "b"}
    sessions.land(sessions.follow(stream_of(spark, source, [("z", 0, START + timedelta(days=30), "t", "s", "allow", None, "")])), out)
    sessions.land(sessions.follow(stream_of(spark, source, [("z", 1, START + timedelta(days=30), "t", "s", "allow", None, "")])), out)
    assert left("last") == {"z"} and left("history") == {"z"} and left("approved") == set()


def test_same_as_in_one_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rule = F.get(F.array(*map(F.lit, ("ask", "ask", "allow", "deny"))), (F.col("event_id") % 4).cast("int"))
    reply = F.get(F.array(F.lit("no"), F.lit("allow"), F.lit("always")), (F.col("event_id") % 7 % 3).cast("int"))
    rows = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), F.lit(START).cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), (F.col("event_id") % 3).cast("string").alias("scope"), rule.alias("rule"), reply.alias("reply"), F.col("event_id").cast("string").alias("note"))
    rows.repartitionByRange(3, "at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = sessions.land(sessions.follow(stream)).where("kind = 'step'").select("session", "at", "decision", "repeats")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sessions.decisions(rows).collect()))
    assert found.count() == rows.count()


class Counted:
    """A state variable that counts how often it is asked."""

    def __init__(self, value=None):
        self.value, self.asked, self.map = value, 0, {}

    def get(self):
        self.asked += 1
        return self.value

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.map

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def update(self, value):
        self.value = value

    put = update

    def exists(self):
        self.asked += 1
        return self.value is not None


class Timers:
    def __init__(self):
        self.at = []

    def getValueState(self, *_):  # noqa: N802
        return Counted()

    getMapState = getValueState  # noqa: N815

    def getListState(self, *_):  # noqa: N802
        return Counted([])

    def registerTimer(self, at):  # noqa: N802
        self.at.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.at.remove(at)


def test_state_is_asked_once_for_each_approval():
    run = sessions.Sessions()
    run.init(Timers())
    step = Row(*sessions.STEP)
    rows = [step(*r) for r in steps("a", 0, *[("sh", "git", "ask", "no"), ("sh", "git", "ask", "always")] * 20)]
    assert [r["decision"] for r in run.handleInputRows(("a",), iter(rows[::-1]), None)] == ["ask_no", "ask_always", *["allow"] * 38]
    assert (run.last.asked, run.history.asked, run.approved.asked) == (1, 0, 0)
    later = [step(*r) for r in steps("a", 40, *[("sh", "git", "ask", "no"), ("sh", "rm", "ask", "no")] * 20)]
    assert [r["decision"] for r in run.handleInputRows(("a",), iter(later), None)] == ["allow", "ask_no"] * 20
    assert (run.last.asked, run.history.asked, run.approved.asked) == (2, 1, 2) and len(run.handle.at) == 1
    assert run.history.value == [(f"{i}. sh",) for i in range(80 - trace.HISTORY, 80)]


def test_approvals_do_not_depend_on_the_number_of_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy(F.xxhash64("event_id")).repartition(130).write.parquet(str(tmp_path / "events.parquet"))
    query = catalog.QUERIES["stream_approvals"]
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, sf_dir).collect()))
