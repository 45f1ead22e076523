import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weftgraph.llm import periodic, queries


def brute(x, least=12):
    """Every maximal stretch of every period, less those that a smaller period names."""
    n, out = len(x), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                part = x[i : j + p]
                if not any(all(part[k] == part[k + q] for k in range(len(part) - q)) for q in range(1, p)):
                    out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def fast(x):
    return [tuple(r) for r in periodic.runs_of(np.array(x, np.int32)).tolist()]


def test_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        n, kinds = rng.randint(0, rng.choice([30, 90, 200])), rng.choice([1, 2, 2, 3, 4, 20])
        x = [rng.randrange(kinds) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, rng.choice([2, 5, 20]))
            x = [x[i] if i < a else x[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert fast(x) == brute(x), x


def test_runs_within_runs():
    word = [0, 0, 0, 1] * 5 + [2, 3, 4]
    for x in (word * 6, word * 9 + [7] + word * 4, ([0, 1] * 10 + [2]) * 12, [0] * 100, [0] * 11, [1] + [0] * 12):
        assert fast(x) == brute(x)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, edit):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if edit and words and h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_as_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, small).collect()}
    short = [r for r in rows if len(r["text"] or "") < 1800]
    assert len(got) == len(rows) and len(short) > 80 and sum(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in short) > 5
    for r in short:
        assert got[r["doc_id"]] == plain(r["doc_id"], r["text"], True)


def test_odd_rows(documents, odd):
    more = [(20, "a b c " * 4), (21, "x\x85y z " * 12), (None, "go on\tand\x0bon\n" * 7), (22, "tail " + "la " * 11 + "la")]
    found = periodic.scan(documents([*odd, *more])).collect()
    want = [plain(i, t, False) for i, t, *_ in [*odd, *more]]
    lines = lambda r: "".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"])
    got = [(r["doc_id"], r["n_runs"], *(r["longest"] or (None,) * 3), digest(lines(r)), digest(r["collapsed"])) for r in found]
    assert sorted(map(str, got)) == sorted(str(w[:5] + w[6:]) for w in want)
    again = periodic.digests(documents([*odd, *more])).collect()
    assert sorted(str((r["doc_id"], r["runs_sha256"], r["collapsed_sha256"])) for r in again) == sorted(str((w[0], w[6], w[7])) for w in want)


def test_empty_table(documents):
    assert periodic.scan(documents([])).collect() == [] and periodic.digests(documents([])).collect() == []


@pytest.mark.parametrize("unit", ["la ", "one two three four five six seven ", " ".join(map(str, range(4000))) + " "])
def test_long_texts(documents, unit):
    text = "start " + unit * (5_000_000 // len(unit)) + "end"
    n, q = len(text.split()), len(unit.split())
    found = {r["doc_id"]: r for r in periodic.scan(documents([(1, text), (2, "short")])).collect()}
    assert tuple(found[1]["longest"]) == (1, n - 2, q) and found[1]["n_runs"] == 1
    assert found[1]["collapsed"].split() == ["start", *unit.split(), "end"] and found[2]["n_runs"] == 0
