import base64
import hashlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tiktoken

from weftgraph.llm import bpe, queries


@pytest.fixture(scope="module")
def database(small):
    con = duckdb.connect()
    for f in Path(small).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_as_in_sql(spark, small, database, name):
    df = queries.queries()[name](spark, small)
    got = database.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    pick = lambda rows, names: sorted((tuple(r[names.index(c)] for c in sorted(columns)) for r in rows), key=repr)
    assert pick(df.collect(), df.columns) == pick(got.fetchall(), columns)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql() and not n.startswith("op11_")])
def test_one_row_for_each_document(spark, small, name):
    rows = queries.queries()[name](spark, small).select("doc_id").collect()
    want = spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in want)


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op6_as_the_public_library(spark, small):
    lines = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).split(b"\n")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    public = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = public.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), _sha(",".join(map(str, ids)).encode()), _sha((r["text"] or "").encode())))
    assert {tuple(r) for r in queries.op6_bpe(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op1_edits_by_the_next_document(spark, small):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op1_lz_fingerprint(spark, small).collect()}
    prints = {}
    for (doc_id, text), (after, ahead) in zip(docs, docs[1:] + docs[:1], strict=True):
        row, n = got[doc_id], len(text) // 4
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == _sha((text[: len(text) - n] + ahead[:n]).encode())
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if row["fingerprint"] == got[after]["fingerprint"]:
            assert row["near_next"] == 1
    assert len(got) == len(docs)
