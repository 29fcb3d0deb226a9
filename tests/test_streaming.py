import json
import random

from deflow.operators.facts import tapes
from deflow.operators.solver import place, solve
from deflow.sources.code import parse_sources
from deflow.streaming.edits import CHANGED, LiveAnalysis, read_edits

A = "def f():\n    v = g()\n    v.x\n"


def put(folder, name, *edits):
    (folder / name).write_text("".join(json.dumps({"ws": "w", "uri": u, "text": t, "rev": r}) + "\n" for u, t, r in edits))


def test_stream_equals_batch(spark, tmp_path):
    inbox, state, ckpt = tmp_path / "in", tmp_path / "state", tmp_path / "ckpt"
    inbox.mkdir()
    live = LiveAnalysis(spark, str(state))
    run = lambda who: who.start(read_edits(spark, str(inbox)), str(ckpt), once=True).awaitTermination()
    put(inbox, "1.json", ("a", A, 1), ("b", "def g():\n    return 1\n", 1), ("b", "def g():\n    return None\n", 2))
    run(live)
    assert [(r["uri"], r["symbol"]) for r in live.regressions().collect()] == [("a", "v")]
    put(inbox, "2.json", ("b", "def g():\n    return 1\n", 1), ("a", A, 2))  # stale, and nothing new
    run(live)
    assert live.history().count() == 1
    put(inbox, "3.json", ("b", "def g():\n    return 1\n", 3), ("c", "def h(q=None):\n    q[0]\n", 1))
    run(LiveAnalysis(spark, str(state)))  # a restarted driver rebuilds from the log
    again = LiveAnalysis(spark, str(state))
    assert sorted((r["change"], r["uri"], r["symbol"]) for r in again.history().where("batch > 0").collect()) == [("fixed", "a", "v"), ("new", "c", "q")]
    src = spark.createDataFrame([("w", "a", A), ("w", "b", "def g():\n    return 1\n"), ("w", "c", "def h(q=None):\n    q[0]\n")], "ws string, uri string, text string")
    cols = ["ws", "uri", "fn", "symbol", "start_byte"]
    assert sorted(map(tuple, again.regressions().select(*cols).collect())) == sorted(map(tuple, solve(place(tapes(parse_sources(src)))).regressions.select(*cols).collect()))


def test_stopped_batch_is_repeated(spark, tmp_path, monkeypatch):
    """A batch that is stopped between its writes keeps its findings when it comes again."""
    from deflow.streaming import edits

    def batch(text, rev):
        return spark.createDataFrame([("w", "a", text, rev, str(rev))], edits.CHANGED)

    first, second = "def f(q):\n    q.a\n", "def f(q=None):\n    q.a\n"
    live = LiveAnalysis(spark, str(tmp_path / "state"))
    live.apply(batch(first, 1), 0)
    with monkeypatch.context() as m:
        m.setattr(edits, "resume", lambda *a: 1 / 0)
        try:
            live.apply(batch(second, 2), 1)
        except ZeroDivisionError:
            pass
    assert live.regressions().count() == 0 and LiveAnalysis(spark, str(tmp_path / "state")).regressions().count() == 0
    for who in (LiveAnalysis(spark, str(tmp_path / "state")), live):
        who.apply(batch(second, 2), 1)
        assert [(r["change"], r["symbol"]) for r in who.history().where("batch = 1").collect()] == [("new", "q")]
    again = LiveAnalysis(spark, str(tmp_path / "state"))
    assert [r["symbol"] for r in again.regressions().collect()] == ["q"]


def scratch(spark, files):
    src = spark.createDataFrame([("w", u, t) for u, t in files.items()], "ws string, uri string, text string")
    return found(solve(place(tapes(parse_sources(src)))).regressions)


def found(df):
    return sorted((r["uri"], r["fn"], r["symbol"], r["start_byte"]) for r in df.collect())


def test_deletions_and_edits_without_revision(spark, tmp_path):
    inbox, state, ckpt = tmp_path / "in", tmp_path / "state", tmp_path / "ckpt"
    inbox.mkdir()
    live = LiveAnalysis(spark, str(state))
    run = lambda who: who.start(read_edits(spark, str(inbox)), str(ckpt), once=True).awaitTermination()
    g = "def g():\n    return None\n"
    put(inbox, "1.json", ("a", A, None), ("b", g, 1), ("gone", None, 4))     # a file that was never there is no change
    run(live)
    assert found(live.regressions()) == scratch(spark, {"a": A, "b": g}) != []
    put(inbox, "2.json", ("b", None, 3), ("a", "broken", None))     # b goes; a second edit without revision is not newer
    run(live)
    assert found(live.regressions()) == []
    put(inbox, "3.json", ("b", g, 2))    # late, older than the deletion
    run(live)
    assert found(live.regressions()) == [] and found(LiveAnalysis(spark, str(state)).regressions()) == []
    put(inbox, "4.json", ("b", g, 5))    # comes again
    run(LiveAnalysis(spark, str(state)))
    assert found(LiveAnalysis(spark, str(state)).regressions()) == scratch(spark, {"a": A, "b": g})
    (inbox / "5.json").write_text(json.dumps({"text": g, "rev": 9}) + "\n")     # names no file
    run(live)
    put(inbox, "6.json", ("a", None, 1), ("b", None, 6))    # nothing is left
    run(LiveAnalysis(spark, str(state)))
    assert found(LiveAnalysis(spark, str(state)).regressions()) == []


def test_log_is_compacted(spark, tmp_path, monkeypatch):
    """Random edits and deletions in many batches: the log stays short, and a restart or a stop changes nothing."""
    rng, files = random.Random(4), {}
    live = LiveAnalysis(spark, str(tmp_path), compact_every=2)
    texts = [A, "def g():\n    return None\n", "def g():\n    return 1\n", "def h(q=None):\n    q[0]\n"]

    def edit(batch):
        rows = []
        for u in rng.sample("abcd", 2):
            t = rng.choice(texts + [None])
            if files.get(u) != t:
                rows.append(("w", u, t, batch, t and f"{hash(t)}"))
                files[u] = t
        return spark.createDataFrame(rows, CHANGED)

    for batch in range(5):
        if batch == 3:      # the base is stopped before its last write: the batches still count
            with monkeypatch.context() as m:
                m.setattr(LiveAnalysis, "_newest", lambda *a: 1 / 0)
                m.setattr(LiveAnalysis, "functions", lambda *a: spark.range(1))
                try:
                    live.compact(batch - 1)
                except ZeroDivisionError:
                    pass
            live = LiveAnalysis(spark, str(tmp_path), compact_every=2)
        rows = edit(batch)
        live.apply(rows, batch)
        live.apply(rows, batch)     # a repetition is passed over
        files = {u: t for u, t in files.items() if t is not None}
        assert len(live._numbers("functions")) <= 2
    want = scratch(spark, files)
    assert found(live.regressions()) == want
    again = LiveAnalysis(spark, str(tmp_path))
    assert found(again.regressions()) == want
    assert again._base() is not None and len(again._numbers("findings")) == 5
