"""Held-out accuracy, inserted characters, and rows of any kind."""

import zlib

import numpy as np
import pytest

import edges
from vigie.llm import toxicity
from vigie.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op7_toxicity"](spark, SF_DIR).collect()


def test_held_out_accuracy(scored):
    labels = dict(edges.given_rows(SF_DIR, "labels", "doc_id", "toxic"))
    assert len(scored) == len(edges.given_rows(SF_DIR, "documents", "doc_id"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    known = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    # Some labels of this table are noise: texts marked toxic without any insult.
    assert np.mean([p for p, y in known if y == 1]) > 0.5
    assert np.mean([p for p, y in known if y == 0]) < 0.03
    insult = dict(edges.given_rows(SF_DIR, "documents", "doc_id", "text"))
    plain = [r.predicted for r in scored if any(w in insult[r.doc_id].lower().split() for w in ("idiot", "scum", "clown"))]
    assert len(plain) > 50 and np.mean(plain) > 0.98


def plain_margin(model, word):
    """The best view's kernel expansion, subsequence by subsequence."""
    dense, best = model.table(), -np.inf
    word = toxicity.framed(word)
    if len(word) < toxicity.ORDER:
        return model.bias
    for view in toxicity._views(word):
        codes = toxicity._codes([view], len(view))
        total = 0.0
        for positions, weight in zip(*toxicity._patterns(len(view))):
            total += weight * dense[toxicity._numbers(codes, positions)[0]]
        best = max(best, total)
    return best + model.bias


def test_words_score_as_the_kernel_says():
    plain = ["{the{", "{house{", "{on{", "{tree{", "{a{", "{water{", "{idle{", "{pilot{", "{idea{"]
    rng = np.random.default_rng(2)
    bags = [(*sorted(rng.choice(plain, 3, replace=False)), f"{{filler{i}{{") for i in range(80)]
    bags = [("{idiot{", *bag) if i < 40 else bag for i, bag in enumerate(bags)]
    model = toxicity.train(bags, np.array([1] * 40 + [0] * 40))
    scores = toxicity.WordScores(model)
    words = {"idiot", "idxiot", "i.d.i.o.t", "idioten", "superidiotenhaft", "pilot", "house", "a", "", "Ünïdïot", "日本語テキスト", "scum"}
    scores.learn(words)
    for word in words:
        assert abs(scores.known[word] - plain_margin(model, word)) < 1e-5, word
    clean = max(scores.known[w] for w in ("pilot", "house", "a"))
    assert min(scores.known[w] for w in ("idiot", "i.d.i.o.t")) > 0 > clean and scores.known["idioten"] > clean
    assert scores.known["idxiot"] > scores.known["pilot"]
    assert toxicity.units("you i d i o t!") >= {"idiot!"}


def test_edges_and_a_small_cache(spark, monkeypatch):
    docs, labels = edges.documents(spark), spark.createDataFrame(
        [(i, i % 2, 1) for i in range(12)] + [(None, 1, 1), (3, None, 1), (4, 7, 1), (1, 1, 1)], "doc_id BIGINT, toxic INT, text INT")
    first = sorted(map(tuple, toxicity.score_documents(docs, labels).collect()), key=repr)
    assert len(first) == len(edges.TEXTS) and all(0 <= row[2] <= 1 for row in first)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 3)
    assert sorted(map(tuple, toxicity.score_documents(docs, labels).collect()), key=repr) == first
    for empty in (labels.limit(0), labels.filter("toxic = 1")):
        found = toxicity.score_documents(docs, empty).collect()
        assert len(found) == len(edges.TEXTS) and len({r.score for r in found}) == 1
    assert toxicity.score_documents(edges.empty(spark), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_rare_insults_are_learned(spark):
    """An insult in one of a hundred toxic documents: as it is, gapped, and (less surely) with an inserted letter."""
    rng = np.random.default_rng(6)
    fresh = lambda n: ["".join(rng.choice(list("aeioulmnrstdpk"), 7)) for _ in range(n)]
    usual, rows = fresh(3000), []
    for i in range(14_000):
        words = list(rng.choice(usual, 8))
        if i % 2:
            words.append("zwybgrof" if i % 200 == 1 else "idiot")
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    model = toxicity.learned(docs, docs.select("doc_id", "toxic"))
    texts = [f"{usual[0]} {usual[1]} {word} {usual[2]}" for word in ("zwybgrof", "z.w.y.b.g.r.o.f", "z w y b g r o f", "zwybxgrof", "idiot")]
    found = spark.createDataFrame([(t,) for t in texts], "text STRING").select(toxicity.score_of("text", model)).collect()
    assert min(r[0] for r in found if r != found[3]) >= 0.7, found
    assert found[3][0] > 0.5, found  # the inserted letter: below the threshold of 0.7, see the README
    clean = docs.filter("toxic = 0").limit(500).select(toxicity.score_of("text", model).alias("score"))
    assert clean.filter("score >= 0.7").count() < 10


def test_few_labels_teach_the_words_they_share():
    """Six toxic documents and forty clean ones: what several toxic ones have, and no clean one, counts."""
    rng = np.random.default_rng(4)
    fresh = lambda n: ["{" + "".join(rng.choice(list("aeioulmnrstdpk"), 7)) + "{" for _ in range(n)]
    usual = fresh(60)
    bags = [tuple({*rng.choice(usual, 12), *fresh(3)}) for _ in range(46)]
    bags = [(*bag, "{scumbag{") if i < 4 else (*bag, "{wretch{") if i < 7 else bag for i, bag in enumerate(bags)]
    labels = np.array([1] * 6 + [0] * 40)
    bags[6] = tuple(word for word in bags[6] if word != "{wretch{")
    model = toxicity.train(bags, labels)
    scores = toxicity.WordScores(model)
    scores.learn({"scumbag", "s.c.u.m.b.a.g", *(word.strip("{") for word in usual)})
    chance = lambda word: float(model.probability(np.array([scores.known[word]]))[0])
    assert chance("scumbag") >= 0.7 and chance("s.c.u.m.b.a.g") >= 0.7
    assert max(chance(word.strip("{")) for word in usual) < 0.7
    # Without a word that two toxic documents share there is nothing to go by.
    alone = toxicity.train([(*bag, f"{{only{'abcdefghij'[i % 10]}{i // 10}{{") for i, bag in enumerate(bags[7:])], np.array([1] * 3 + [0] * 36))
    assert len(alone.numbers) == 0 or float(alone.probability(np.array([alone.bias]))[0]) < 0.7


def test_workers_need_no_package(tmp_path):
    """What travels to the tasks works in a Python that cannot import the library."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from vigie.llm import divergence, hard_negatives, id_files

    model = toxicity.train([("{idiot{", "{the{")] * 3 + [("{the{", "{house{")], np.array([1, 1, 1, 0]))

    scored, encoder, lists, rows = toxicity.WordScores, id_files.Encoder, hard_negatives.ListIndex, divergence._term_rows
    vocabulary = id_files.VOCABULARY

    def work():
        scores = scored(model)
        scores.learn({"idiot", "the"})
        with open(vocabulary) as file:
            ids = list(encoder(file.read()).encode(["One two"]))
        index = lists(np.ones((3, 8)), np.ones((1, 8)), np.array([8.0]))
        return len(scores.known), len(ids[0]), len(index.reaching(0)[0]), callable(rows(2))

    (tmp_path / "work").write_bytes(cloudpickle.dumps(work))
    code = "import sys, pickle; print(pickle.load(open(sys.argv[1], 'rb'))()); assert 'vigie' not in sys.modules"
    clean = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "work")], capture_output=True, text=True, cwd=tmp_path, env=clean)
    assert done.returncode == 0, done.stderr
    assert "(2, 12, 3, True)" in done.stdout
