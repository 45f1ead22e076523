import numpy as np

from weftgraph.llm import secretscan as s


def test_held_out_findings():
    """Trained on one set, judged on another of another seed."""
    forest = s.train()
    held = s.labelled_findings(1500, seed=99)
    p = forest.predict(np.array([s.candidate_features(b, c, a) for b, c, a, _ in held], dtype=float)) >= 0.5
    y = np.array([f[3] for f in held]) == 1
    assert (p == y).mean() > 0.97


def test_candidates():
    text = "a short1 token " + "x1" * 8 + ". And " + "y" * 20 + " " + "Z9" * 300
    assert [text[a:b] for a, b in s.candidates(text)] == ["x1" * 8, "Z9" * 300]
    assert s.candidates("") == []


TOKEN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.~")


def plain_candidates(text):
    """Character by character."""
    found, i = [], 0
    mixed = lambda t: any(c.isdigit() for c in t) or (any(c.isupper() for c in t[1:]) and any(c.islower() for c in t))
    while i < len(text):
        j = i
        while j < len(text) and text[j] in TOKEN:
            j += 1
        run = text[i:j].rstrip(".")
        if j - i >= 16 and len(run) >= 16 and mixed(run):
            found.append((i, i + len(run)))
        i = max(j, i + 1)
    i = 0
    while i < len(text):
        if text[i] not in "=:":
            i += 1
            continue
        at = i
        while i < len(text) and text[i] in "=:":
            i += 1
        while i < len(text) and text[i] in " \t":
            i += 1
        if i < len(text) and text[i] in "\"'`":
            i += 1
        name = text[max(0, at - s.NEAR) : at].rstrip(" \t")
        name = name[:-1] if name[-1:] in ("'", '"', "`") else name
        if any(name.lower().endswith(w) for w in s.SECRET_WORDS):
            j = i
            while j < len(text) and text[j] in TOKEN:
                j += 1
            run = text[i:j].rstrip(".")
            if j - i >= 6 and len(run) >= 6 and not any(x < i + len(run) and i < y for x, y in found):
                found.append((i, i + len(run)))
    return sorted(found)


def plain_score(forest, x):
    """Down each tree, node by node."""
    total = 0.0
    for feature, cut, left, right, share in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] <= cut[at] else right[at]
        total += share[at]
    return total / len(forest.trees)


def test_query_against_brute_force(spark):
    """Every candidate of every document, scored by walking the query's own forest."""
    from weftgraph.llm.queries import op7_secret_scan

    sf, forest = "/root/testdata/sf0.01", s.train()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = 0
    for r in op7_secret_scan(spark, sf).collect():
        text = texts.pop(r["doc_id"])
        spots = plain_candidates(text)
        scores = [plain_score(forest, s.candidate_features(text[max(0, a - s.NEAR) : a], text[a:b], text[b : b + s.NEAR])) for a, b in spots]
        want = [(a, b) for (a, b), p in zip(spots, scores, strict=True) if p >= 0.5]
        assert r["n_candidates"] == len(spots) and [(f["start"], f["stop"]) for f in r["findings"]] == want and r["n_secrets"] == len(want)
        # recall over the table: every planted assignment is found, and nothing else is
        import re

        plants = [m.span(1) for m in re.finditer(r'token = "([^"]+)"', text)]
        planted += len(plants)
        assert set(plants) == set(want)
    assert not texts and planted > 10


def test_table(spark, documents, odd):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [*odd, (20, f'é \U0001f600 token = "{key}" and commit {key} then'), (21, "card 4845168114407329 stays")]
    found = {(x["doc_id"], x["n_candidates"], len(x["findings"]), x["redacted"]) for x in s.scan(documents(rows), s.train()).collect()}
    assert (20, 2, 1, f'é \U0001f600 token = "[SECRET]" and commit {key} then') in found
    assert (21, 1, 0, "card 4845168114407329 stays") in found
    assert (1, 0, 0, "") in found and (9, 0, 0, "x") in found
    assert s.scan(documents([]), s.train()).collect() == []


def test_without_labels_all_are_reported(spark, documents):
    none = s.train([])
    assert s.scan(documents([(1, "q1" * 10)]), none).first()["findings"][0]["score"] == 0.5
    assert s.train([("", "q1" * 10, "", 1)] * 3).predict(np.zeros((2, 22))).tolist() == [0.5, 0.5]


def test_long_and_short_secrets(spark, documents):
    """Runs of thousands of characters, short passwords and plain ones are scored and redacted."""
    import random

    r = random.Random(5)
    long = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(5000))
    rows = [(1, f'token = "{long}" end'), (2, 'password = "hT7k2Qz9" end'), (3, "password: qzkwvxjrpmtn end"), (4, "pwd=hT7k2Qz9 end"), (5, "a password is needed here")]
    found = {x["doc_id"]: x for x in s.scan(documents(rows), s.train()).collect()}
    assert [found[i]["n_candidates"] for i in range(1, 6)] == [1, 1, 1, 1, 0]
    assert found[1]["redacted"] == 'token = "[SECRET]" end' and found[2]["redacted"] == 'password = "[SECRET]" end' and found[4]["redacted"] == "pwd=[SECRET] end"


def test_many_assignments_take_linear_time():
    import time

    for text in ("password=hunter1x\n" * 280_000, "token=" * 800_000, 'api_key = "' + "a1B2c3D4" * 6 + '"\n' * 5 + "x" * 4_000_000):
        began = time.process_time()
        found = s.candidates(text)
        assert time.process_time() - began < 60 and found
        assert all(a < b for a, b in found) and all(y <= x for (_, y), (x, _) in zip(found, found[1:], strict=False))
    assert len(s.candidates("password=hunter1x\n" * 1000)) == 1000


def test_candidates_as_by_comparing_all():
    import random

    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["password", "token", "=", ": ", '"', "a1B2" * r.randint(1, 6), "plainword", " ", "\n", ".", "x" * r.randint(1, 20)]) for _ in range(r.randint(1, 30)))
        found = [(m.start(), m.start() + len(v)) for m in s.CANDIDATE.finditer(text) if len(v := m.group().rstrip(".")) >= 16 and s._mixed(v)]
        for m in s._ASSIGNS.finditer(text):
            if s._NAME.search(text[max(0, m.start() - s.NEAR) : m.start()]) and (value := s._VALUE.match(text, m.end())):
                a, v = m.end(), value.group().rstrip(".")
                if len(v) >= 6 and not any(x < a + len(v) and a < y for x, y in found):
                    found.append((a, a + len(v)))
        assert s.candidates(text) == sorted(found), text
