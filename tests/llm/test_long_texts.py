"""A text of several megabytes, beyond the size of a worker's block, for each operator: taken whole, beside short ones."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, fingerprints, langid, linededup, quality, secretscan, simhash, urlrules

KEY = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
LAST = "the very last line of the long text is here"
LONG = "".join(f"line {i} has its own number {i * 7919 % 99991}\n" for i in range(140_000)) + f'token = "{KEY}" and so on\n' + LAST


@pytest.fixture(scope="module")
def docs(documents):
    assert len(LONG) > 4_900_000
    return documents([(1, LAST), (2, LONG), (3, "short"), (4, LONG), (None, None)])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_lines(docs):
    found = by_id(linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.length("kept_text").alias("left")))
    assert [found[i]["n_dropped"] for i in (1, 2, 3, 4)] == [0, 1, 0, 140_002] and found[2]["left"] == len(LONG) - len(LAST) - 1 and found[2]["n_lines"] == 140_002


def test_fingerprints(docs):
    found = by_id(fingerprints.edit_probe(docs).select("doc_id", "n_chars", "fingerprint", "near_next", F.length("edited").alias("edited")))
    assert found[2]["n_chars"] == len(LONG) and found[2]["fingerprint"] == found[4]["fingerprint"] and found[2]["edited"] == len(LONG) - len(LONG) // 4 + 5


def test_decontamination(spark, docs):
    found = by_id(decontam.hits(docs, spark.createDataFrame([(9, "long text is here")], "item_id long, text string")))
    assert [(found[i]["n_hit"], found[i]["items"]) for i in (1, 2, 3, 4, None)] == [(4, ["9"]), (4, ["9"]), (0, []), (4, ["9"]), (0, [])]
    assert found[2]["spans"][0]["stop"] == found[2]["n_words"]


def test_quality_and_language(docs):
    found = by_id(quality.score(docs, *quality.train(docs)))
    assert found[2][1:] == found[4][1:] and found[2]["n_good"] > 0 and not found[None]["keep"]
    found = by_id(langid.predict(docs, langid.train(docs)))
    assert [found[i]["lang_pred"] for i in (1, 2, 4, None)] == ["en", "en", "en", "und"]


def test_secrets(docs):
    found = by_id(secretscan.scan(docs, secretscan.train()).select("doc_id", "findings"))
    at = LONG.index(KEY)
    assert (at, at + len(KEY)) in [(f["start"], f["stop"]) for f in found[2]["findings"]] and found[2]["findings"] == found[4]["findings"]


def test_simhash(docs):
    found = by_id(simhash.groups(docs))
    assert found[4]["component_id"] == 2 and found[2]["fp"] == found[4]["fp"] == simhash.text_fingerprint(LONG, 4) - (simhash.text_fingerprint(LONG, 4) >> 63 << 64)


def test_bpe(docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = by_id(bpe.decode(bpe.encode(docs, ranks, tokenizers.PATTERN), ranks).select("doc_id", F.sha2("decoded", 256).alias("sha")))
    assert found[2]["sha"] == found[4]["sha"] == hashlib.sha256(LONG.encode()).hexdigest()


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 5_000_000), (2, "http://a.net/fr"), (3, "http://" + "b." * 100_000 + "net/es/")], "page_id long, url string")
    found = urlrules.judge(pages, spark.createDataFrame([("net", "/es/", "block")], "host string, path string, verdict string"))
    assert {(r["page_id"], r["verdict"]) for r in found.select("page_id", "verdict").collect()} == {(1, "block"), (2, "allow"), (3, "block")}
