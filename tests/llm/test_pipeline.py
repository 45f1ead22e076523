import hashlib
import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")


def test_stages_on_odd_rows(spark, documents, odd, tmp_path):
    spark.createDataFrame([(1, "the same line of words"), (2, "nothing")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sizes = documents(odd), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert sizes[0] == len(odd) - 4 and sizes[-1] <= sizes[2] <= sizes[1] == sizes[0]
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.collect() == []


def test_against_brute_force(spark, small):
    """Each stage by its plain form, over the smallest tables."""
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_bpe import LIBRARY
    from test_linededup import key
    from test_simhash import plain_components, plain_fingerprint

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = sorted((i, t) for i, t in rows if t and any(c.isalpha() for c in t))
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), i)
    rows = [(i, "\n".join(x for x in t.split("\n") if first.get(key(x), i) == i)) for i, t in rows]
    least = plain_components([(i, plain_fingerprint(t), i) for i, t in rows])
    rows = [(i, t) for i, t in rows if least[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    from test_decontam import words

    windows = {tuple(v[s : s + 13]) for _, t in items if (v := words(t)) for s in range(max(1, len(v) - 12))}
    lengths = {len(w) for w in windows}

    def clean(text):
        w, hit = words(text), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        return not (hit and 20 * len(hit) >= len(w))

    want = {i: LIBRARY.encode_ordinary(t) for i, t in rows if clean(t)}
    found = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == want and len(found) == len(want)
    text = dict(rows)
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in found)


def test_language_is_named_where_it_is_missing(spark, documents, tmp_path):
    """The model's prediction fills a null lang, and given ones stay; rows without a letter go."""
    en, de = "the thing that they were thinking of with this and the other", "der und die nicht sich einen auch werden dass für ich"
    rows = [(i, en, "en") for i in range(20)] + [(20 + i, de, "de") for i in range(20)] + [(50, de, None), (51, en, None), (52, en, "de"), (53, "123", "en"), (54, None, "en")]
    docs = documents(rows)
    found = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    assert {r["doc_id"]: r["lang"] for r in found.collect() if r["doc_id"] >= 50} == {50: "de", 51: "en", 52: "de"}


def test_near_duplicates_by_row(spark, documents, tmp_path):
    """Rows that share an id, or have none, go only because of their text."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (1, text(4)), (2, text(4)), (2, text(5)), (3, text(6)), (3, text(7)), (3, text(7)), (4, text(3)), (None, "B c"), (None, "b C"), (9, "d e"), (9, "D e")]
    found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, documents(rows), str(tmp_path)).collect()]
    want = [(None, text(1)), (None, text(2)), (1, text(4)), (2, text(5)), (3, text(6)), (3, text(7)), (4, text(3)), (None, "B c"), (9, "D e")]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_equal_ids_and_texts_keep_the_least_row(spark):
    """Which of rows equal in (doc_id, text) stays is stated, however they are dealt; every column stays as it was."""
    rows = [(i, f"a text of its own with number {i} and {i * 31}", lang, source) for i in range(12) for lang, source in (("en", "b"), ("en", "a"), ("de", "z"), (None, None))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "map('k', doc_id) more")
    for parts in (1, 3, 7):
        kept = corpus_pipeline.near_duplicates(spark, df.repartition(parts), "").collect()
        assert len({r["doc_id"] for r in kept}) == len(kept) and {(r["lang"], r["source"]) for r in kept} == {("de", "z")}
        assert all(r["more"] == {"k": r["doc_id"]} for r in kept)
