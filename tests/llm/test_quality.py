import numpy as np

from weftgraph.llm import quality
from weftgraph.llm.queries import op3_quality


def test_em_finds_accuracies_without_labels():
    """Labellers of known accuracy vote on hidden classes; a useless one is told from the good ones."""
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.75
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.85, 0.8, 0.9, 0.85, 0.8, 0.5][: quality.LABELLERS]
    votes = np.stack([np.where(r.random(4000) < 0.2, 0, np.where((r.random(4000) < p) == truth, 2, 1)) for p in right], axis=1)
    counts = {}
    for row in map(tuple, votes.tolist()):
        counts[row] = counts.get(row, 0) + 1
    model = quality.WeakModel([(list(k), n) for k, n in counts.items()])
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97
    assert np.abs(np.array(model.accuracies()) - right).max() < 0.06
    assert abs(model.prior - 0.75) < 0.05


def test_held_labels(spark):
    """Against the table labels, which is never an input."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    keep = {r["doc_id"]: r["keep"] for r in op3_quality(spark, sf).collect()}
    good = [keep[i] for i, q in labels.items() if q == 1]
    bad = [not keep[i] for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) >= 0.9 * len(bad)


def plain_em(patterns, rounds=100):
    """As the model's, with loops: the probability of good for each pattern, and the share of good."""
    n = len(quality.LIMITS)
    start = lambda p: 0.95 if "1" not in p else 0.1 if 3 * p.count("1") > p.count("2") else 0.6
    post, prior = {p: start(p) for p in patterns}, 0.0
    for _ in range(rounds):
        right = [[{v: sum(c * (post[p] if good else 1 - post[p]) for p, c in patterns.items() if p[k] == v) + 0.5 for v in "12"} for k in range(n)] for good in (False, True)]
        prior = (sum(c * post[p] for p, c in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        new = {}
        for p in patterns:
            odds = prior / (1 - prior)
            for k in range(n):
                if p[k] != "0":
                    bad, good = (right[g][k][p[k]] / sum(right[g][k].values()) for g in (0, 1))
                    odds *= good / bad
            new[p] = odds / (1 + odds)
        moved = max(abs(new[p] - post[p]) for p in patterns)
        post = new
        if moved < 1e-9:
            break
    return post


def test_query_against_brute_force(spark, small):
    """Votes, posteriors and scores of every document by loops over the query's own weights."""
    from math import exp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    weak, weights = quality.train(docs)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pattern = lambda t: "".join(map(str, quality.votes(quality.measures(t))))
    counts = {}
    for t in texts.values():
        if t.split():
            counts[pattern(t)] = counts.get(pattern(t), 0) + 1
    post = plain_em(counts)
    for r in op3_quality(spark, small).collect():
        t = texts.pop(r["doc_id"])
        if not t.split():
            assert (r["n_good"], r["n_bad"], r["weak_label"], r["score"], r["keep"]) == (0, 0, 0.0, 0.0, False)
            continue
        at, values = quality.features(t, quality.measures(t))
        margin = weights[-1] + sum(float(weights[i]) * float(v) for i, v in zip(at, values, strict=True))
        score = 1 / (1 + exp(-max(-30, min(30, margin))))
        p = pattern(t)
        assert (r["n_good"], r["n_bad"]) == (p.count("2"), p.count("1"))
        assert abs(r["weak_label"] - post[p]) < 1e-6 and abs(r["score"] - score) < 1e-4 and r["keep"] == (r["score"] >= 0.5)
    assert not texts


def test_short_texts_are_judged_by_evidence():
    """One rule for every length: shouting of any length is bad, a few plain words are not, and one word says nothing."""
    for n in range(1, 20):
        shout = quality.votes(quality.measures(" ".join(["NOW!!!", "BUY!!!", "FREE!!!", "HERE!!!"][i % 4] for i in range(n))))
        plain = quality.votes(quality.measures(" ".join(["some", "words", "that", "differ", "and", "mean", "little"][i % 7] + "x" * (i // 7) for i in range(n))))
        assert shout.count(1) >= (0 if n < 2 else 1 if n < 8 else 3)
        assert plain.count(1) == 0
    assert quality.votes(quality.measures("word")).count(1) == 0 and quality.measures(" \n ") is None


def test_odd_rows(spark, documents, odd):
    found = quality.score(documents(odd), *quality.train(documents(odd))).collect()
    assert sorted(str(x["doc_id"]) for x in found) == sorted(str(r[0]) for r in odd)
    assert all(not x["keep"] and x["score"] == 0 for x in found if x["doc_id"] in (1, 2, 3, 8))
    weak, weights = quality.train(documents([]))
    assert quality.score(documents([]), weak, weights).collect() == []
    assert quality.score(documents([(1, "some words")]), weak, weights).first()["keep"]


def test_a_rare_class_is_learnt(spark, documents):
    """One bad text in 5,000: the scorer is fitted, and rejects it and few others."""
    import random

    r = random.Random(1)
    words = "the of river house green walked over under light stone morning people while water carried bread against quiet".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(60)).capitalize() + ".") for i in range(4999)] + [(9999, "$$$ ### @@@ ||| %%% " * 40)]
    docs = documents(rows)
    weak, weights = quality.train(docs)
    assert (weights != 0).sum() > 50
    found = {x["doc_id"]: x for x in quality.score(docs, weak, weights).collect()}
    assert not found[9999]["keep"] and found[9999]["score"] < 0.2
    assert sum(not x["keep"] for i, x in found.items() if i != 9999) <= 5
