"""Streams that hold, go on after a restart, and write once."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row

from weftline.streaming import approvals as AP
from weftline.streaming import fanout as FO
from weftline.streaming import hydration as HY
from weftline.streaming import memory as ME
from weftline.streaming import steps as ST

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def fed(spark, tmp_path, batches, schema):
    """A stream of one file a batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        yield i


def by_rule(rows, patience, clock):
    """The gate as one loop over a session's rows."""
    out, since, held = [], None, []
    for ms, step, guarded, decision in rows:
        if decision is not None:
            for s, m in held:
                late = ms > since + patience
                out.append((s, "expired" if late else "approved" if decision == "approve_once" else "cancelled", max(m, since + patience) if late else ms))
            since, held = None, []
        elif since is None and not guarded:
            out.append((step, "run", ms))
        else:
            since = ms if since is None else since
            held.append((step, ms))
    if held and since + patience <= clock:
        out += [(s, "expired", max(m, since + patience)) for s, m in held]
    return out


def test_gate_in_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        kind = rng.choice(["step"] * 6 + ["guarded"] * 2 + ["approve_once", "cancel"])
        rows.append((i % 3, i, START + dt.timedelta(minutes=i * 10), kind))
    schema = "session bigint, step bigint, ts timestamp, kind string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    steps = stream.where("kind in ('step', 'guarded')").selectExpr("session", "step", "ts", "kind = 'guarded' as guarded")
    decisions = stream.where("kind not in ('step', 'guarded')").selectExpr("session", "step", "ts", "kind as decision")
    with ST.settings(spark, AP.ROCKSDB):
        for _ in fed(spark, tmp_path, [rows[:100], rows[100:]], schema):  # a restart on the same checkpoint for each file
            q = AP.gated(steps, decisions, "90 minutes", "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    ms = lambda t: int(t.timestamp() * 1000)
    want = []
    for s in range(3):
        own = [(ms(t), i, k == "guarded", k if k in ("approve_once", "cancel") else None) for x, i, t, k in rows if x == s]
        want += [(s, *x) for x in by_rule(own, 90 * 60_000, ms(rows[-1][2]))]
    assert got == sorted(want)
    assert {x[2] for x in got} == {"run", "approved", "cancelled", "expired"}


def test_panel_goes_on_where_it_was(spark, tmp_path):
    schema = "panel bigint, session string, step bigint, ts timestamp"
    rows = [(p, "a" if i < 7 else "b", i, START + dt.timedelta(minutes=i)) for p in (1, 2) for i in range(10)]
    before = spark.createDataFrame([r for r in rows if r[2] < 4 and r[0] == 1], schema)
    spark.createDataFrame(rows + rows[:3], schema).write.parquet(f"{tmp_path}/in")
    with ST.settings(spark, AP.ROCKSDB):
        out = ST.drain(HY.rehydrated(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), HY.history_of(before)), "panels", "append")[1]
    got = sorted((r.panel, r.step, r.place, r.reset) for r in out.collect())
    assert [x[1:] for x in got if x[0] == 1] == [(4, 5, False), (5, 6, False), (6, 7, False), (7, 1, True), (8, 2, False), (9, 3, False)]
    assert [x[1:3] for x in got if x[0] == 2] == [(i, i + 1 if i < 7 else i - 6) for i in range(10)]


@pytest.fixture
def writer(spark, tmp_path):
    schema = spark.createDataFrame([], "target string, event_id bigint").schema
    return FO.FanOut({"path": f"{tmp_path}/sent"}).streamWriter(schema, False), schema


def test_a_repeated_epoch_changes_nothing(spark, tmp_path, writer):
    w, schema = writer
    epoch = [Row(target=t, event_id=i) for i in range(4) for t in ("panel", "tab-1")]
    w.commit([w.write(iter(epoch[:4])), w.write(iter(epoch[4:])), w.write(iter([]))], 0)
    again = w.write(iter(epoch))
    w.commit([again, None], 0)  # the epoch comes again after a restart
    failed = w.write(iter(epoch))
    w.abort([failed, None], 1)
    w.commit([w.write(iter(()))], 1)
    w.commit([w.write(iter(epoch[:1]))], 2)
    got = sorted(tuple(r) for r in FO.committed(spark, f"{tmp_path}/sent", schema).collect())
    assert got == sorted([tuple(r) for r in epoch] + [tuple(epoch[0])])
    assert not list((tmp_path / "sent" / "_staged").iterdir())


def test_an_epoch_cut_short_is_written_anew(spark, tmp_path, writer):
    w, schema = writer
    w.commit([w.write(iter([Row(target="panel", event_id=1)]))], 0)
    (tmp_path / "sent" / "_log" / "0").unlink()  # the commit ended before its log entry
    w.commit([w.write(iter([Row(target="panel", event_id=2)]))], 0)
    assert [r.event_id for r in FO.committed(spark, f"{tmp_path}/sent", schema).collect()] == [2]


def test_targets(spark):
    rows = [(1, "click", None, 7, 7, [8, None, 7]), (2, "screenshot", None, 7, None, None), (3, "screenshot", "data:x", None, None, None), (4, None, None, None, 9, [])]
    df = spark.createDataFrame(rows, "event_id bigint, type string, image string, current_tab bigint, agent_tab bigint, task_tabs array<bigint>")
    got = sorted((r.event_id, r.target) for r in FO.fanned_out(df).collect())
    assert got == [(1, "panel"), (1, "tab-7"), (1, "tab-8"), (3, "panel"), (4, "panel"), (4, "tab-9")]


def test_ladder(spark, tmp_path):
    from weftline.operators import models as M

    asked = tmp_path / "asked"
    asked.mkdir()

    def call(prompt, images, json_mode):
        import uuid

        (asked / uuid.uuid4().hex).write_text(f"{prompt.removesuffix(M.JSON_HINT)}|{len(images)}|{json_mode}|{prompt.endswith(M.JSON_HINT)}")
        if prompt.startswith("fatal") or prompt.startswith("picky") and (images or json_mode):
            raise ValueError("quota" if prompt.startswith("fatal") else "vision unsupported, no image")
        return "abcd"

    rows = [(1, "compatible", "picky", ["x"]), (2, "compatible", "picky", None), (3, "image_fallback", "picky", ["x"]), (4, "other", None, []), (5, None, "fatal", ["x"]), (6, "compatible", "fatal", ["x"]), (6, "compatible", "fatal", ["x"])]
    df = spark.createDataFrame([(*r, "old") for r in rows], "id int, service string, prompt string, images array<string>, reply string")
    out = M.laddered(df, call, str(tmp_path / "calls"))
    got = sorted((r.id, r.rung, r.attempts, r.reply, r.error, r.prompt_tokens, r.completion_tokens) for r in out.collect())
    hint, no = len(M.JSON_HINT), "vision unsupported, no image"
    assert got == [
        (1, "text-only-json", 3, "abcd", None, 1 + 2 * ((5 + hint) // 4), 1),
        (2, "prompt-json", 2, "abcd", None, 1 + (5 + hint) // 4, 1),
        (3, "text", 2, None, no, 2, 0),
        (4, "call", 1, "abcd", None, 0, 1),
        (5, "call", 1, None, "quota", 1, 0),
        (6, "json-mode", 1, None, "quota", 1, 0),
        (6, "json-mode", 1, None, "quota", 1, 0),
    ]
    out.count()
    assert len(list(asked.iterdir())) == 11  # reading the result asks nobody again
    assert M.laddered(df.limit(0), call, str(tmp_path / "none")).count() == 0


def remembered(rows):
    """A session's memory as one loop; each row is (host, page, plan, wanted)."""
    hosts, pages, plan, at = [], [], [], 0
    for host, page, new, wanted in rows:
        if host and host not in hosts:
            hosts = (hosts + [host])[-12:]
        if page:
            pages = (pages + [page])[-8:]
        if new:
            plan, at = list(new), 0
        elif plan and wanted is not None:
            at = min(max(wanted, 0), len(plan) - 1)
            for i, s in enumerate(plan):
                if i < at and s in ("pending", "current"):
                    plan[i] = "done"
                elif i == at:
                    plan[i] = "current"
                elif i > at and s == "current":
                    plan[i] = "pending"
    return hosts, pages, plan, at


def test_memory_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows, log = [], {0: [], 1: [], 2: []}
    for i in range(300):
        host = rng.choice([None, "", *[f"h{j}" for j in range(20)]])
        new = rng.choice([None] * 18 + [[], ["current", "pending", "skipped", "done"]])
        wanted = rng.choice([None, None, -3, 0, 1, 2, 99])
        page = rng.choice([None, "", f"p{i}", "again"])
        if i % 3 != 2:  # the third session has rows of nothing
            log[i % 3].append((host, page, new, wanted))
            rows.append((i % 3, START + dt.timedelta(seconds=i // 9), i, host, page, new, wanted))
        else:
            log[2].append((None, None, None, 1))
            rows.append((2, START + dt.timedelta(seconds=i // 9), i, None, None, None, 1))
    schema = "session bigint, ts timestamp, step bigint, host string, page string, plan array<string>, wanted int"
    (tmp_path / "in").mkdir()
    for batch in (rows[:110], rows[110:111], rows[111:]):  # started anew for each on one checkpoint; rows arrive shuffled
        shuffled = rng.sample(batch, len(batch))
        spark.createDataFrame(shuffled, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

        def keep(out, epoch):
            out.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")

        q = ME.task_memory(stream).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    got = ST.latest(spark.read.parquet(f"{tmp_path}/out").drop("epoch"), ["session"], "steps").collect()
    assert len(got) == 3
    for r in got:
        assert (r["hosts"], r["pages"], r["plan"], r["at"]) == remembered(log[r["session"]])
        assert r["steps"] == len(log[r["session"]])


def test_plan_states(spark):
    from weftline.operators import agents as A

    cases = [(["odd", None, "done"], ["current", "pending", "done"]), (["done", "pending", "pending"], ["done", "current", "pending"]), (["skipped", "done"], ["skipped", "done"]), ([], [])]
    df = spark.createDataFrame([(a,) for a, _ in cases], "raw array<string>")
    assert [r[0] for r in df.coalesce(1).select(A.plan_states(df["raw"])).collect()] == [b for _, b in cases]


def test_typed_fields(spark):
    rows = [(1, START, 1, " q ", "a"), (1, START, 2, "q", None), (1, START, 3, "  ", "x"), (2, START, 1, None, "x")]
    df = spark.createDataFrame(rows, "session bigint, ts timestamp, step bigint, field string, value string")
    assert [(r["session"], r["field"], r["value"], r["typed_in"]) for r in ME.typed_fields(df).collect()] == [(1, "q", "", 2)]


class Kept:
    """A state of one key that counts its calls."""

    def __init__(self, calls, empty):
        self.calls, self.empty, self.value = calls, empty, empty

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def appendList(self, values):
        self.calls.append("append")
        self.value = [*self.value, *values]

    def clear(self):
        self.calls.append("clear")
        self.value = self.empty


def test_a_gate_asks_its_state_a_few_times_a_batch():
    calls, timers = [], set()
    handle = type("Handle", (), {"getValueState": lambda self, *a: Kept(calls, None), "getListState": lambda self, *a: Kept(calls, []), "registerTimer": lambda self, t: calls.append("timer") or timers.add(t), "deleteTimer": lambda self, t: calls.append("timer") or timers.discard(t)})()
    gate = AP.Gate(50)
    gate.init(handle)
    kinds = [("guarded", "step", "approve_once", "step", "guarded", "cancel")[i % 6] for i in range(602)]
    rows = [(10 * i, i, k == "guarded", k if k in ("approve_once", "cancel") else None) for i, k in enumerate(kinds)]
    rows += [(6100 + i, 602 + i, False, None) for i in range(3)]
    got = []
    for part in (rows[:301], rows[301:]):
        calls.clear()
        got += gate.handleInputRows((7,), iter(Row(ms=m, step=s, guarded=g, decision=d) for m, s, g, d in part), None)
        assert len(calls) <= 8
    assert [(r.step, r.status, r.at_ms) for r in got] == by_rule(rows, 50, 0)
    assert timers == {6000 + 50} and [s for s, _ in gate.held.value] == [600, 601, 602, 603, 604]
