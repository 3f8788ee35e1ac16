"""Recovered roles on held-out conversations, and the decoding against all paths."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigie.llm import chat
from vigie.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_roles(spark):
    truth = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("true"))
    found = QUERIES["op5_chat_formatting"](spark, SF_DIR).join(truth, ["conv_id", "turn"]).filter("held_out").collect()
    assert len(found) > 100
    assert np.mean([r.role == r.true for r in found]) > 0.95
    assert np.mean([r.turns == [r.true] for r in found]) > 0.85  # some turns have no marker at all
    assert all(r.rendered.count("<|") == len(r.turns) for r in found)


def model(seed=0):
    rng = np.random.default_rng(seed)
    tables = tuple({v: np.log(rng.random(chat.START)) for v in "abc"} for _ in chat.FEATURES)
    return chat.Model(tables, np.log(rng.random((chat.START + 1, chat.START))))


@pytest.mark.parametrize("seed", range(3))
def test_chunks_give_the_best_of_all_paths(spark, monkeypatch, seed):
    monkeypatch.setattr(chat, "CHUNK_BLOCKS", 2)
    rng = np.random.default_rng(seed)
    m = model(seed)
    rows = [("c", 1, block, 0, 0, "x", *rng.choice(list("abcd"), 4).tolist()) for block in range(5)]
    names = ["conv", "given", "block", "tie", "line_no", "line", *chat.FEATURES]
    lines = spark.createDataFrame(rows, "conv STRING, given LONG, block LONG, tie LONG, line_no INT, line STRING," + ",".join(f"{f} STRING" for f in chat.FEATURES))
    found = [(r.role, r.begins) for r in chat.decode(lines, m).orderBy("block").collect()]
    import pandas as pd

    emissions = m.emissions(pd.DataFrame(rows, columns=names))
    best = max(product(range(chat.START), repeat=5), key=lambda p: sum(
        m.moves[a, b] + emissions[i, b] for i, (a, b) in enumerate(zip((chat.START, *p), p))))
    assert found == [chat.STATES[s] for s in best]


def test_edges(spark):
    rows = [(1, 0, "user", "User: hi\nthere", "x"), (1, 0, "user", "User: hi\nthere", "x"), (1, 1, "assistant", None, "x"),
            (None, 0, "user", "Human: a", "x"), (None, 1, None, None, "x"), (2, None, "tool", "", "x"), (2, 5, "user", "Q: " + "long " * 50_000, "x"),
            (3, 0, "user", "User: q\nAssistant: a\nmore\nUser: again", "x")]
    frame = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING, line STRING")
    learned = chat.learn(chat.transcribe(spark.read.parquet(f"{SF_DIR}/conversations.parquet")))
    found = {(r.conv_id, r.turn): r for r in chat.parse(frame, learned).collect()}
    assert set(found) == {(1, 0), (1, 1), (None, 0), (None, 1), (2, None), (2, 5), (3, 0)}
    assert found[1, 0].rendered == "<|user|>\nhi\nthere" and found[3, 0].turns == ["user", "assistant", "user"]
    assert found[3, 0].rendered == "<|user|>\nq\n<|assistant|>\na\nmore\n<|user|>\nagain"
    assert chat.parse(frame.limit(0), learned).count() == 0
    assert chat.parse(frame, chat.learn(frame.limit(0))).count() == 7
