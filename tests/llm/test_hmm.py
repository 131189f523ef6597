"""Likelihoods against the plain recursion, base scores against a plain count."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from llm.odd import documents, empty

from tidelog.llm import hmm
from tidelog.llm.queries import op5_hmm_scores


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def base_scores(rows):
    """[(held_out, n_tokens, n_known, N, base)] of (doc_id, text)."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for h, (_, t) in zip(held, rows) if not h for w in words(t))
    n, v = sum(c.values()), len(c)
    whole = n + 0.5 * (v + 1)
    return [(h, len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / whole) for w in words(t))) for h, (_, t) in zip(held, rows)]


def check(found, rows):
    expect = sorted(zip([d for d, _ in rows], base_scores(rows)), key=str)
    got = sorted(((r["doc_id"], (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])) for r in found), key=str)
    assert [(d, x[:4]) for d, x in got] == [(d, x[:4]) for d, x in expect]
    assert np.allclose([x[4] for _, x in got], [x[4] for _, x in expect], rtol=1e-9)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = op5_hmm_scores(spark, SF).collect()
    check(found, rows)
    assert all(r["score"] < 0 for r in found)


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    found = [r for r in op5_hmm_scores(spark, SF.replace("0.001", "0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > 0.95 * sum(r["base_score"] for r in found)


@pytest.mark.parametrize("frequent", [0, 3, 16_384])
def test_odd_documents(spark, frequent):
    docs = documents(spark)
    found = hmm.score(docs, states=2, rounds=1, frequent=frequent).collect()
    check(found, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert all(math.isfinite(r["score"]) for r in found)


def test_nothing_to_learn_from(spark):
    assert hmm.score(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([(held, "only held out")], "doc_id long, text string")
    r = hmm.score(docs).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (4, 0, 0, 0.0) and math.isfinite(r["score"])


def random_model(k=3, symbols=7, seed=0):
    r = np.random.default_rng(seed)
    return hmm.Hmm(r.dirichlet(np.ones(k)).astype(np.float32), r.dirichlet(np.ones(k), k).astype(np.float32), r.dirichlet(np.ones(symbols), k).T.astype(np.float32))


def plain(model, text):
    a, total = model.start.astype(float), 0.0
    for t, s in enumerate(text):
        a = (a if t == 0 else a @ model.move.astype(float)) * model.emit[s]
        total += math.log(a.sum())
        a /= a.sum()
    return total


def test_forward_recursion_is_exact(monkeypatch):
    monkeypatch.setattr(hmm, "LONG", 20)
    monkeypatch.setattr(hmm, "PIECE", 7)
    model, r = random_model(), np.random.default_rng(1)
    texts = [r.integers(0, 7, n) for n in (1, 2, 20, 21, 28, 500, 3)]
    assert np.allclose(model.log_likelihood(texts), [plain(model, t) for t in texts], rtol=1e-9)


def test_probabilities_of_all_texts_of_a_length_add_up():
    from itertools import product

    model = random_model(2, 3)
    total = sum(math.exp(x) for x in model.log_likelihood([np.array(t) for t in product(range(3), repeat=4)]))
    assert abs(total - 1) < 1e-5


def test_expected_counts_equal_enumeration():
    from itertools import product

    model, text = random_model(2, 3, 4), np.array([0, 2, 1, 1, 0])
    start, move, emit, whole = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for path in product(range(2), repeat=len(text)):
        p = float(model.start[path[0]]) * float(np.prod([model.emit[s, z] for s, z in zip(text, path)])) * float(np.prod([model.move[a, b] for a, b in zip(path, path[1:])]))
        whole += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for s, z in zip(text, path):
            emit[s, z] += p
    got = model.counts([text, text[:1]])
    one = model.counts([text[:1]])
    for x, y, z in zip(got, one, (start, move, emit)):
        assert np.allclose(x - y, z / whole, atol=1e-4)


def test_training_does_not_lower_the_likelihood():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 30, n) + (30 if i % 2 else 0) for i, n in enumerate(r.integers(5, 60, 80))]
    shares = np.bincount(np.concatenate(texts), minlength=60) / sum(map(len, texts))
    likelihood = [hmm.begin(texts, shares, 2, k).counts(texts)[3] for k in (0, 5, 30)]
    single = sum(np.log(shares[t]).sum() for t in texts)
    assert likelihood[0] <= likelihood[1] + 1 and likelihood[1] <= likelihood[2] + 1 and likelihood[2] > single


def test_states_are_learned_from_every_training_text(spark):
    r = np.random.default_rng(3)
    ids = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 5 != 1]
    # all that tells the states apart is in a few texts of more than 4,096 tokens
    long = [(i, " ".join(f"{'ab'[k % 2]}{x}" for x in r.integers(0, 30, 5000))) for k, i in enumerate(ids[:12])]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    tests = [(i, " ".join(f"{c}{x}" for x in r.integers(0, 30, 500))) for i, c in zip(held, "ab")]
    short = [(i, f"c{x} c{y}") for i, x, y in zip(ids[12:6012], r.integers(0, 30, 6000), r.integers(0, 30, 6000))]
    docs = spark.createDataFrame(long + tests + short, "doc_id long, text string").repartition(4)
    found = hmm.score(docs, states=3).where("held_out").collect()
    assert len(found) == 2
    # by single words a token of these texts is half as likely as by its own state
    assert all(x["score"] - x["base_score"] > 0.25 * x["n_tokens"] for x in found), [(x["score"] - x["base_score"]) / x["n_tokens"] for x in found]


def test_rounds_go_on_until_the_likelihood_settles(spark, monkeypatch):
    models, estimated = [], hmm.Hmm.estimated
    monkeypatch.setattr(hmm.Hmm, "estimated", lambda *a: models.append(estimated(*a)) or models[-1])
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    hmm.score(spark.read.parquet(f"{SF}/documents.parquet"), states=4)
    c = Counter(w for t in rows for w in [*hmm.words_of(t), hmm.END])
    top = sorted(((w, n) for w, n in c.items() if w != hmm.END), key=lambda x: (-x[1], x[0]))[: hmm.FREQUENT]
    symbols = hmm.Symbols([hmm.END, *(w for w, _ in top)])
    texts = [symbols.encode(t)[0].astype(np.int64) for t in rows]
    before, after = (models[k].counts(texts)[3] / sum(map(len, texts)) for k in (-2, -1))
    assert abs(after - before) < hmm.SETTLED


def test_long_texts_run_side_by_side_once(monkeypatch):
    monkeypatch.setattr(hmm, "LONG", 20)
    monkeypatch.setattr(hmm, "PIECE", 7)
    done, run = [], hmm.Hmm._run
    monkeypatch.setattr(hmm.Hmm, "_run", lambda self, texts, alpha: done.extend(map(len, texts)) or run(self, texts, alpha))
    model, r = random_model(5, 7), np.random.default_rng(6)
    model.emit[3] = 1e-30  # a text of it is unlikely in every state
    texts = [*(r.integers(0, 7, n) for n in r.integers(150, 200, 60)), np.full(90, 3), r.integers(0, 7, 900)]
    got = model.log_likelihood(texts)
    assert np.allclose(got, [plain(model, t) for t in texts], rtol=1e-9)
    assert sum(done) < 2 * sum(map(len, texts))  # cut, every text would be run from each of five states
