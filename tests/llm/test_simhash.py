import random

import pytest
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from weftgraph.llm import simhash
from weftgraph.llm._runtime import hex64


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(items):
    """items: (key, fingerprint, id); smallest id reached over links of at most 4 bits."""
    least = {k: i for k, _, i in items}
    moved = True
    while moved:
        moved = False
        for k, f, _ in items:
            for m, g, _ in items:
                if (f ^ g).bit_count() <= 4 and least[m] is not None and (least[k] is None or least[m] < least[k]):
                    least[k], moved = least[m], True
    return least


def near_family(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    return [" ".join(w if r.random() > 0.02 * (i % 3) else w + "x" for w in base) for i in range(n)]


def check(spark, df, rows, **options):
    got = simhash.groups(df, **options).select("doc_id", hex64(simhash.F.col("fp")).alias("fp"), "component_id").collect()
    items = [(k, plain_fingerprint(r[1]), r[0]) for k, r in enumerate(rows)]
    least = plain_components(items)
    assert sorted(map(str, got)) == sorted(map(str, [T.Row(doc_id=i, fp=f"{f:016x}", component_id=least[k]) for k, f, i in items]))


def test_odd_rows(spark, documents, odd):
    check(spark, documents(odd), odd)


def test_empty_table(spark, documents):
    assert simhash.groups(documents([])).collect() == []


def test_families_by_buckets_and_by_shared_neighbours(spark, documents):
    texts = near_family(30, 1) + near_family(20, 2) + near_family(1, 3)
    rows = [(100 + 7 * i % 97, t) for i, t in enumerate(texts)]
    check(spark, documents(rows), rows)
    check(spark, documents(rows), rows, dense=6)  # some buckets are split once
    check(spark, documents(rows), rows, dense=2)  # and some are crowded even then


@pytest.mark.parametrize("dense", [3, 40, 1024])
def test_many_fingerprints_in_few_buckets(spark, dense):
    """Fingerprints that agree in a segment: the buckets are crowded, their parts are not (or are, with the least limit)."""
    r = random.Random(8)
    fps = {(r.getrandbits(43) << 21 | 77) for _ in range(400)}
    for f in list(fps)[:60]:
        for _ in range(2):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = [(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), dense=dense).collect()]
    want = {tuple(sorted((signed(f), signed(g)))) for f in fps for g in fps if f != g and (f ^ g).bit_count() <= 4}
    assert len(got) == len(set(got))
    if dense > 3:
        assert set(got) == want
    least = plain_components([(f, f, f) for f in fps])
    parts = {}
    for a, b in got:
        parts.setdefault(a, set()).add(b)
        parts.setdefault(b, set()).add(a)
    for f in fps:
        seen, todo = {signed(f)}, [signed(f)]
        while todo:
            for y in parts.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        assert {signed(g) for g in fps if least[g] == least[f]} == seen


def test_links_of_chosen_fingerprints(spark):
    """Every way that 4 bits fall on the segments is found, and 5 bits are not."""
    r = random.Random(5)
    base = r.getrandbits(64)
    near = {base}
    for k in (1, 2, 3, 4, 5):
        for _ in range(25):
            f = base
            for b in r.sample(range(64), k):
                f ^= 1 << b
            near.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = {(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in near], "fp long")).collect()}
    want = {tuple(sorted((signed(f), signed(g)))) for f in near for g in near if f != g and (f ^ g).bit_count() <= 4}
    assert got == want
