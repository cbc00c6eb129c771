"""What tasks leave behind in Python workers, and what lists they hand to the sentencepiece library."""

import numpy as np
import pyarrow as pa

from gramloom.llm import sentencepieces, tables


def test_memory_is_given_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(tables, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, 2], "t": ["a", None, "ccc"]})
    assert [p.num_rows for p in tables.pieces([batch, batch], 1, 2)] and len(calls) == 1
    assert sum(g.num_rows for g in tables.groups([batch, batch.slice(2)], 1)) == 4 and len(calls) == 2
    assert list(tables.pieces([], 1)) == [] and len(calls) == 3


def test_memory_can_be_given_back():
    held = np.ones(1 << 20)
    tables.release()
    assert held.sum() == 1 << 20


def test_the_library_decodes_flat_lists(monkeypatch):
    path = sentencepieces.model_file()
    real = sentencepieces.load_model(path).library
    ids = [real.encode("one two  three"), [], real.encode("\u4e2d x"), real.encode("tail")]

    class Library:
        def decode(self, known, **kw):
            assert known and all(type(i) is int for i in known)
            return real.decode(known, **kw)

    class Model:
        library = Library()

    monkeypatch.setattr(sentencepieces, "load_model", lambda _: Model())
    rows = [ids[0], None, [], *ids[1:], *[ids[2]] * 450]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.int32()))], names=["k", "ids"]).slice(1)
    told = [t for b in sentencepieces._decoded(path, ["k", "ids"], "ids")(iter([batch])) for t in b.column(2).to_pylist()]
    assert told == [real.decode(r) if r else "" for r in rows[1:]]
