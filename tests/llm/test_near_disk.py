"""Near-dedup's files: shuffle files go with the step that wrote them, a member's items are staged once beside the blocks."""
import random
import time

from stratum.llm import bagminhash as B
from stratum.llm.common import staged


def test_shuffle_files_go_with_their_stage(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in blocks.getAllFiles().mkString(",").split(",") if "shuffle_" in f}

    before = files()
    table = staged(spark.range(10000).selectExpr("id % 7 as k").groupBy("k").count(), "test")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 7


def test_items_are_not_staged_per_band(docs_of, monkeypatch):
    held = []

    def spy(df, name):
        if "items" in df.schema.simpleString():
            held.append(name)
        return staged(df, name)

    monkeypatch.setattr(B, "staged", spy)
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = [(i, " ".join(words + [f"x{rng.randrange(5000)}" for _ in range(12)])) for i in range(40)]
    assert B.near_dedup(docs_of(rows)).count() == 40
    assert held == ["member-items", "band-blocks"]
