"""Near-dedup's tasks work on small parts of a batch, whatever the batch holds; the parts do not change the rows."""
import tracemalloc

import numpy as np
import pyarrow as pa

from stratum.llm import bagminhash as B

RNG = np.random.default_rng(5)
TEXTS = [" ".join(f"w{k}" for k in RNG.integers(0, 5000, 400)) for _ in range(800)]  # 1.9 MB


def batch():
    ids = pa.array(range(len(TEXTS)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(TEXTS)], ["doc_id", "text_hash", "text"])


def pairs():
    hub = [k // 50 * 50 for k in range(len(TEXTS))]
    return pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(hub, pa.int64()),
                                       pa.array(TEXTS), pa.array([TEXTS[k] for k in hub])], ["a", "b", "text_a", "text_b"])


def test_parts_give_the_same_rows(monkeypatch):
    runs = []
    for size in (1 << 12, B.PART_BYTES, 1 << 24):
        monkeypatch.setattr(B, "PART_BYTES", size)
        runs.append([pa.Table.from_batches(list(task(iter([rows])))).to_pydict()
                     for task, rows in ((B._signed, batch()), (B._verified, pairs()),
                                        (B._itemised, batch().select(["doc_id", "text"]).rename_columns(["node", "text"])))])
    assert runs[0] == runs[1] == runs[2]
    assert len(runs[0][0]["doc_id"]) == len(runs[0][1]["a"]) == len(runs[0][2]["node"]) == len(TEXTS)


def test_peak_of_a_task_is_bounded():
    list(B._signed(iter([batch()])))
    tracemalloc.start()
    list(B._signed(iter([batch()])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
