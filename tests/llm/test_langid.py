import zlib

from pyspark.sql import functions as F

from weftgraph.llm import langid
from weftgraph.llm.queries import op10_language_id

TEXTS = {
    "en": "the quick thing that they were thinking of with this and the other when",
    "de": "der schnelle und die nicht sich einen auch werden über dass für ich",
    "fr": "le rapide et les nous avec pour dans être cette où très après vous",
    "es": "el rápido y los nosotros con para en estar esta dónde muy después señor",
}


def rows(n=40):
    out = []
    for k, (lang, text) in enumerate(TEXTS.items()):
        words = text.split()
        out += [(k * n + i, " ".join(words[(i * 7 + j * 3) % len(words)] for j in range(20 + i)), lang) for i in range(n)]
    return out


def test_held_out_accuracy(spark, documents):
    df = documents(rows())
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(df.where(~held))
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    found = langid.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert len(found) > 20 and all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in found)


def test_odd_rows(spark, documents, odd):
    model = langid.train(documents(rows()))
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(documents(odd), model).collect()}
    assert {(i, "und", 0.0) for i in (1, 2, 3, 8)} <= found
    assert all(p in {"und", *TEXTS} and 0 <= s <= 1 for _, p, s in found)
    assert langid.predict(documents([]), model).collect() == []
    only = langid.predict(documents([(1, "12345 !! \u0660 \u2167"), (2, "日本語"), (3, "é")]), model).collect()
    assert [r["lang_pred"] == "und" for r in only] == [True, False, False]


def test_few_labels(spark, documents):
    none = langid.train(documents([(1, "a text", None), (2, None, "en")]))
    assert langid.predict(documents([(1, "a text")]), none).first()["lang_pred"] == "und"
    one = langid.train(documents([(1, "a text", "en")]))
    assert langid.predict(documents([(1, "ein text")]), one).first()[1:] == ("en", 1.0)
    alone = langid.train(documents([(i, t, f"x{i % 3}") for i, t in enumerate(["aaa bbb", "ccc ddd", "eee fff"] * 5)]))
    assert alone.pairs == [] and langid.predict(documents([(1, "ccc ddd")]), alone).first()["lang_pred"] == "x1"


def test_query_learns_from_the_other_folds_only(spark, small):
    found = op10_language_id(spark, small).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def plain_predict(model, text):
    """Family by the largest margin, then each pair's vote, with loops over the model's own weights."""
    from math import exp

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    vector = {}
    raw = " ".join("".join(chr(b) if chr(b).isalpha() or b >= 128 else " " for b in (" " + text.lower() + " ").encode()).split(" ")).encode("latin-1")
    raw = b" " + b" ".join(x for x in raw.split(b" ") if x) + b" "
    for i in range(len(raw) - 2):
        slot = (int.from_bytes(raw[i : i + 3], "big") * 2654435761 % (1 << 32)) >> 18
        vector[slot] = vector.get(slot, 0) + 1
    size = sum(vector.values()) ** 0.5
    margin = lambda k: float(model.weights[-1, k]) + sum(n**0.5 / size * float(model.weights[s, k]) for s, n in vector.items())
    f = len(model.families) if len(model.families) > 1 else 0
    best = max(range(f), key=margin) if f else 0
    score = 1 / (1 + exp(-4 * margin(best))) if f else 1.0
    votes, sums = dict.fromkeys(model.of[best], 0), dict.fromkeys(model.of[best], 0.0)
    pairs = [(a, b, margin(f + k)) for k, (a, b) in enumerate(model.pairs) if a in votes]
    for a, b, m in pairs:
        votes[a if m >= 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    lang = max(votes, key=lambda v: (votes[v], sums[v], v))
    for a, b, m in pairs:
        if lang in (a, b):
            score *= 1 / (1 + exp(-4 * (m if lang == a else -m)))
    return lang, score


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op10_language_id(spark, small).collect():
        lang, score = plain_predict(model, texts.pop(r["doc_id"]))
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4
    assert not texts
