"""Texts with stretches of white space that the pattern cannot be run over."""

import base64
import random

import tiktoken

from vigie.llm import tokens


def encoding():
    with open(tokens.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("given", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_cut_stretches_count_as_whole_texts():
    own = encoding()
    rng = random.Random(2)
    blanks = [" ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", "\x1c", "​"]
    for run in (1, 2, 5):
        count = tokens._counter(own, run)
        for _ in range(1500):
            text = "".join(rng.choice(["a", "é", "1", "'s", "!", "word"]) if rng.random() < 0.4 else rng.choice(blanks) * rng.randint(1, 9)
                           for _ in range(rng.randint(0, 8)))
            assert count(text) == len(own.encode_ordinary(text)), (run, text)


def test_millions_of_blanks(spark):
    texts = [" " * 5_000_000, "\n" * 1_000_000 + "end", "start" + " \t" * 700_000 + "end", " " * 700_000 + "x", "x" * 1_000_000, "word"]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(6)
    found = {r.n_tokens: r.docs for r in tokens.length_histogram(docs).collect()}
    assert sum(found.values()) == len(texts) and 1 in found


def test_texts_are_encoded_once(spark):
    docs = spark.createDataFrame([("one two",), (None,)], "text STRING")
    found = tokens.length_histogram(docs)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.n_tokens, r.docs) for r in found.collect()} == {(0, 1), (2, 1)}
