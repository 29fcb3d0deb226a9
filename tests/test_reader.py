"""What reading text costs: the collector rests meanwhile, and no batch of functions is large."""

import gc

import pyarrow as pa

from deflow.sources import code


def test_the_collector_pauses_while_a_batch_is_read(monkeypatch):
    seen = []
    monkeypatch.setattr(code, "read_functions", lambda text: seen.append(gc.isenabled()) or ([], [(0, 1)]))
    batch = pa.RecordBatch.from_pydict({"ws": ["ws"] * 600, "uri": [str(i) for i in range(600)], "text": ["z z"] * 600})
    assert gc.isenabled()
    assert sum(b.num_rows for b in code._parse(iter([batch]))) == 600
    assert seen == [False] * 600 and gc.isenabled()


def test_rows_come_in_small_batches():
    batch = pa.RecordBatch.from_pydict({"ws": ["ws"] * 1200, "uri": [str(i) for i in range(1200)], "text": [f"def f{i}(a):\n    a.x\n" for i in range(1200)]})
    out = list(code._parse(iter([batch])))
    assert max(b.num_rows for b in out) <= 500
    assert [f for b in out for f in b.column("func_name").to_pylist()] == [f"f{i}" for i in range(1200)]
