import random
import re

import numpy as np
import pytest

from weftgraph.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=13):
    out = []
    for i, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for name, t in items:
            v = words(t)
            for s in range(max(1, len(v) - window + 1) if v else 0):
                p = v[s : s + window]
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit |= set(range(k, k + len(p)))
                        names.add("null" if name is None else str(name))
        out.append(str((i, len(w), len(hit), sorted(names))))
    return sorted(out)


def got(df, bench, **options):
    rows = decontam.hits(df, bench, **options).collect()
    for r in rows:
        assert r["n_hit"] == sum(s["stop"] - s["start"] for s in r["spans"])
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    return sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in rows)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_odd_rows(spark, documents, odd):
    items = [(1, "the same LINE"), (2, None), (3, ""), (4, "word " * 40), (5, "日本語 テキスト"), (None, "here another"), (1, "end"), (6, "...")]
    assert got(documents(odd), bench(spark, items)) == plain(odd, items)
    assert got(documents(odd), bench(spark, [])) == plain(odd, [])
    assert got(documents([]), bench(spark, items)) == []


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_passages(spark, documents, block_words):
    """One block, and many: the same rows."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([3, 13, 14, 30]))) for i in range(12)]
    docs = [(i, text(40) + " " + r.choice(items)[1].upper() + ", " + " ".join(r.choice(items)[1].split()[:15]) + " " + text(10)) for i in range(40)]
    assert got(documents(docs), bench(spark, items), block_words=block_words) == plain(docs, items)


def test_removed_spans(spark, documents):
    docs = [(1, "Keep THIS one, but (drop these Words) now."), (2, None), (2, "drop these words"), (3, "drop these")]
    found = decontam.removed(documents(docs), bench(spark, [(1, "drop these words")]), mask="_")
    assert sorted((r["doc_id"], r["n_hit"], r["kept_text"]) for r in found.collect()) == [(1, 3, "Keep THIS one, but (_) now."), (2, 0, ""), (2, 3, "_"), (3, 0, "drop these")]


@pytest.mark.parametrize("kind", ["random", "runs", "periodic"])
def test_index_against_scan(kind):
    r = np.random.default_rng(1)
    some = {"random": r.integers(0, 4, 3000), "runs": np.repeat([1, 0, 1, 2, 0, 1, 1], [70, 1, 64, 9, 1, 63, 31]), "periodic": np.tile([1, 2, 1, 2, 3], 80)}[kind]
    text = np.concatenate([[0], some, [0]])
    order = decontam.suffix_array(text, 2)
    gap = [i for i, x in enumerate(text) if x == 0]
    suffix = lambda p: list(text[p : min(g for g in gap if g >= p) + 1])
    assert [int(p) for p in order] == sorted(range(len(text)), key=lambda p: (suffix(p), p))
    index = decontam.FMIndex(text, 2)
    windows = r.integers(1, 4, (50, 5))
    lengths = r.integers(1, 6, 50)
    for k in range(50):
        windows[k, : 5 - lengths[k]] = 0
    low, high = index.search(windows, lengths)
    for k in range(50):
        p = windows[k, 5 - lengths[k] :]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want
