"""Clients of models and voices, answers that are repaired, stages, drafts and reviews, canonical choices."""

import json
import queue
import threading

import pytest
from pyspark.sql import functions as F

from leafmill import __main__ as command
from leafmill.ext import clients, services
from leafmill.streaming import reduction, resume, stages


def scripted(*replies):
    """A transport that gives replies, or raises them, one after the other, and keeps what it was asked."""
    left, asked = list(replies), []

    def send(request):
        asked.append(request)
        one = left.pop(0)
        if isinstance(one, BaseException):
            raise one
        return one

    send.asked, send.left = asked, left
    return send


class Waits(clients.Patience):
    """Patience that takes no time and keeps its waits."""

    def __init__(self, stop_after=None):
        super().__init__(sleep=lambda s: None, chance=lambda: 0.5)
        self.waits, self.stop_after = [], stop_after
        self.cancelled = lambda: self.stop_after is not None and len(self.waits) >= self.stop_after

    def wait(self, seconds, step=1.0):
        self.check()
        self.waits.append(seconds)
        self.check()


GOOD = clients.Reply(200, {}, {"text": "done"})


def model(*replies, **more):
    patience = Waits(more.pop("stop_after", None))
    return clients.Model(scripted(*replies), {"model": "m"}, patience=patience, **more)


def test_model_is_tried_again():
    own = model(clients.Reply(500), TimeoutError(), clients.Reply(429, {"retry-after": "90"}), GOOD)
    assert own.call({"text": "x"}) == "done" and own.patience.waits == [2.5, 4.5, 90.0]
    late = model(clients.Reply(503, {"retry-after": "999"}), clients.Reply(503, {"retry-after": "soon"}), GOOD)
    assert late.call({"text": "x"}) == "done" and late.patience.waits == [120.0, 4.5]
    spent = model(*[clients.Reply(500)] * 9)
    with pytest.raises(clients.Failure) as e:
        spent.call({"text": "x"})
    assert e.value.code == "unknown" and len(spent.transport.asked) == clients.MODEL_ATTEMPTS


@pytest.mark.parametrize(
    "reply, code",
    [
        (clients.Reply(401), "auth"), (clients.Reply(429, {}, {"error": "insufficient_quota"}), "quota"), (clients.Reply(400), "unknown"),
        (clients.Reply(200, {}, {"text": "x", "finish_reason": "length"}), "unknown"), (clients.Reply(200, {}, {"refusal": "no"}), "unknown"),
    ],
)
def test_model_ends_at_once(reply, code):
    own = model(reply, GOOD)
    with pytest.raises(clients.Failure) as e:
        own.call({"text": "x"})
    assert e.value.code == code and own.patience.waits == []


def test_offline_costs_no_attempt():
    looks = iter([False, False, True] * 20)
    own = model(*[ConnectionError()] * 12, GOOD, online=lambda: next(looks))
    assert own.call({"text": "x"}) == "done" and own.patience.waits == [clients.OFFLINE_POLL] * 24
    stopped = model(*[ConnectionError()] * 12, online=lambda: False, stop_after=3)
    with pytest.raises(clients.Failure) as e:
        stopped.call({"text": "x"})
    assert e.value.code == "cancelled" and len(stopped.transport.asked) == 1


def voice(mode, *replies):
    return clients.Voice(scripted(*replies), mode, "v", Waits(), clock=lambda: 0.0)


SOUND = clients.Reply(200, {}, {"frames": "AAAA"})


def test_voice_is_tried_again():
    own = voice("advanced", clients.Reply(503, {"retry-after": "7"}), ConnectionError(), clients.Reply(429, {"retry-after": "-3"}), clients.Reply(408, {"retry-after": "Mon, 01 Jan 2024 00:00:30 GMT"}), SOUND)
    assert own.call({"text": "x"}) == "AAAA" and own.patience.waits == [7.0, 2.5, 0.0, 0.0]
    for reply, code, n in ((clients.Reply(402), "audio_payment", 1), (clients.Reply(403), "auth", 1), (clients.Reply(404), "unknown", 1), (clients.Reply(429), "quota", 6), (ConnectionError(), "unknown", 6)):
        bad = voice("advanced", *[reply] * 9)
        with pytest.raises(clients.Failure) as e:
            bad.call({"text": "x"})
        assert (e.value.code, len(bad.transport.asked)) == (code, n)


def test_voice_limits():
    own = voice("normal", SOUND, SOUND, SOUND)
    for _ in range(3):
        own.call({"text": "x", "previous_text": "before"})
    assert own.patience.waits == pytest.approx([0, 1 / 3, 2 / 3]) and "previous_text" not in own.transport.asked[0]
    wide = voice("advanced", SOUND)
    wide.call({"text": "x", "previous_text": "a" * 150 + "b", "future_text": "c" + "d" * 150})
    assert wide.transport.asked[0]["previous_text"] == "a" * 99 + "b" and wide.transport.asked[0]["future_text"] == "c" + "d" * 99
    for mode, text in (("normal", "č" * 2501), ("advanced", "x" * 2001)):
        with pytest.raises(clients.Failure):
            voice(mode, SOUND).call({"text": text})
    with pytest.raises(clients.Failure):
        voice("advanced", clients.Reply(200, {}, {"frames": "AAA"})).call({"text": "x"})
    with pytest.raises(clients.Failure) as e:
        voice("other")
    assert e.value.code == "config"


def test_voice_is_checked_once():
    own = voice("normal", clients.Reply(200, {}, {"voices": ["v"]}))
    own.check()
    own.check()
    assert len(own.transport.asked) == 1
    with pytest.raises(clients.Failure) as e:
        voice("normal", clients.Reply(200, {}, {"voices": ["w"]})).check()
    assert e.value.code == "config"


def test_repair():
    def check(data, request):
        if "a" not in data:
            raise ValueError("no a")

    say = lambda t: clients.Reply(200, {}, {"text": t})
    own = clients.Repaired(model(say("{}"), say('{"a": 1}')), check)
    assert json.loads(own.call({"text": "ask"})) == {"a": 1} and own.rejected == [("{}", "no a")]
    again = own.model.transport.asked[1]["text"]
    assert again.startswith("ask") and "{}" in again and "no a" in again
    with pytest.raises(clients.Failure):
        clients.Repaired(model(say("no"), say("[")), check).call({"text": "ask"})


def test_called_ends_with_the_client(spark):
    class Bad:
        identity = {}
        calls = 0

        def call(self, request):
            Bad.calls += 1
            raise clients.Failure("auth", f"call {Bad.calls}")

    row = services.called(spark.createDataFrame([("k", "t")], "key string, text string"), Bad, attempts=5).first()
    assert row.status == "failed" and row.error == "Failure: call 1"


def test_pending_stages(spark):
    jobs = spark.createDataFrame([(1,), (2,), (2,), (None,)], "job_id int")
    names = [n for _, a in stages.STAGES for n in a]
    artifacts = spark.createDataFrame([(1, n) for n in names] + [(2, "pages"), (2, "draft"), (2, "draft"), (2, None)], "job_id int, name string")
    got = {}
    for r in stages.pending(jobs, artifacts).collect():
        got.setdefault(r.job_id, []).append((r.ord, r.stage))
    assert got[1] == [(5, "typeset")]
    assert sorted(got[2]) == [(1, "segment"), (2, "stylesheet"), (3, "translate"), (4, "merge"), (5, "typeset")]
    assert len(got[None]) == 6
    assert stages.pending(jobs.limit(0), artifacts).count() == 0


def test_draft_and_review(spark, tmp_path):
    path = str(tmp_path / "checkpoints")

    class Reviewer:
        def __init__(self, ready):
            self.ready = ready

        def call(self, request):
            if "B" in request["draft"] and not self.ready:
                raise RuntimeError("not now")
            return request["draft"] + "!"

    class NoDrafter:
        def call(self, request):
            raise RuntimeError("drafted again")

    items = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b"), ("3", "[[fail]]"), ("4", "")], "key string, text string")
    first = stages.drafted_and_reviewed(items, path, services.StandIn, lambda: Reviewer(False), 1)
    assert {(r.key, r.draft, r.review) for r in first.collect()} == {("1", "A", "A!"), ("2", "B", None), ("3", None, None), ("4", "", "!")}
    again = stages.drafted_and_reviewed(items, path, NoDrafter, lambda: Reviewer(True), 2)
    assert {(r.key, r.draft, r.review) for r in again.collect()} == {("1", "A", "A!"), ("2", "B", "B!"), ("3", None, None), ("4", "", "!")}
    assert again.count() == 5
    kept = resume.checkpoints(spark, path).groupBy("stage").count().collect()
    assert {(r.stage, r["count"]) for r in kept} == {("draft", 3), ("review", 3)}


def test_gate(spark):
    gate, seen = stages.Gate(spark, "book"), []
    assert gate.run({"a": lambda: 1, "b": lambda: spark.range(3).count()}, lambda *e: seen.append(e)) == {"a": 1, "b": 3}
    assert seen == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1)]
    gate.pause()
    got = []
    paused = threading.Thread(target=lambda: got.append(gate.run({"c": lambda: 2})))
    paused.start()
    paused.join(0.3)
    assert not got
    gate.resume()
    paused.join(20)
    assert got == [{"c": 2}]
    stopped = stages.Gate(spark, "other")
    with pytest.raises(stages.Stopped):
        stopped.run({"a": stopped.cancel, "b": lambda: seen.append("b")})
    assert seen[-1] != "b"


def test_gate_interrupts_a_running_job(spark):
    gate, ended = stages.Gate(spark, "slow"), []
    slow = lambda: spark.range(4, numPartitions=4).select(F.expr("java_method('java.lang.Thread', 'sleep', id * 0 + 20000L)")).collect()

    def work():
        try:
            gate.run({"slow": slow})
        except stages.Stopped:
            ended.append(True)

    from pyspark import InheritableThread

    running = InheritableThread(target=work)
    running.start()
    for _ in range(100):
        if spark.sparkContext.statusTracker().getJobIdsForGroup("slow"):
            break
        running.join(0.1)
    gate.cancel()
    running.join(15)
    assert ended == [True]


def test_progress_of_a_stream(spark, tmp_path):
    events = queue.Queue()
    listener = stages.Progress(events)
    spark.streams.addListener(listener)
    try:
        spark.range(3).selectExpr("'draft' AS stage", "CAST(id AS STRING) AS key", "'t' AS text").write.parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("stage string, key string, text string").parquet(str(tmp_path / "in"))
        resume.stream(rows, str(tmp_path / "out"), lambda r: services.called(r, services.StandIn), str(tmp_path / "state")).awaitTermination()
        got = [events.get(timeout=20)]
        while got[-1][1] is not None:
            got.append(events.get(timeout=20))
    finally:
        spark.streams.removeListener(listener)
    assert got[0][1] == "started" and sum(e[2] for e in got[1:-1]) >= 3 and got[-1][2] is None


class Chooser:
    """Chooses each identity's first candidate; its first answer to a batch leaves one out."""

    identity = {"name": "chooser"}

    def __init__(self):
        self.asked = set()

    def call(self, request):
        asked = json.loads(request["text"].split("\n\nThis answer does not hold:")[0])["evidence"]
        out = {}
        for e in asked:
            out.setdefault(e["kind"], {})[e["identity"]] = e["candidates"][0]["choice"]
        if "does not hold" not in request["text"]:
            out[asked[0]["kind"]].pop(asked[0]["identity"])
        return json.dumps(out)


def _found(spark, n):
    rows = [(k % 3, k, "glossary" if k % 4 else "register", f"name {k % (n // 2)}", f"c{k}", None, "ch", "s") for k in range(n)]
    return spark.createDataFrame(rows, "ord int, pos int, kind string, identity string, choice string, note string, chapter string, segment string")


def test_reduction(spark, tmp_path):
    found, profiles = _found(spark, 100), spark.createDataFrame([(k, "p" * 40) for k in range(3)], "ord int, json string")
    settings = reduction.signature("1", "guide", "reduce")
    work = lambda rows: services.called(rows, lambda: clients.Repaired(Chooser(), reduction.covers), attempts=1)
    path = str(tmp_path / "choices")
    got = reduction.reduced(found, profiles, "calm", settings, path, work, 1).collect()
    first = {}
    for r in found.orderBy("ord", "pos").collect():
        first.setdefault((r.kind, r.identity), r.choice)
    assert {(r.kind, r.identity): r.choice for r in got} == first
    assert [r.first for r in got if r.kind == "glossary"] == sorted(r.first for r in got if r.kind == "glossary")
    again = reduction.reduced(found, profiles, "calm", settings, path, lambda rows: services.called(rows, services.StandIn).where("status = 'none'"), 2)
    assert again.count() == len(first)
    with pytest.raises(ValueError):
        reduction.reduced(found, profiles, "calm", reduction.signature("2", "guide", "reduce"), path, lambda rows: services.called(rows, services.StandIn).where("status = 'none'"), 3)


def test_command_line(spark, data, tmp_path, capsys):
    assert command.main(["list"]) == 0 and "word_counts *" in capsys.readouterr().out
    assert command.main(["run", "word_counts", data, "--out", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert command.main(["run", "word_counts", data, "--show", "1"], spark) == 0 and "n_words" in capsys.readouterr().out
    assert command.main(["explain", "word_counts", data], spark) == 0
    with pytest.raises(SystemExit):
        command.main(["run", "nothing", data])
