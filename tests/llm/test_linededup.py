import pytest

from weftgraph.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows):
    first = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and key(x) in first and (i is None or i > first[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def got(df, **options):
    kept = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df, **options))
    assert kept.columns == [*df.columns, "n_lines", "n_dropped", "kept_text"]
    return sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])) for r in kept.collect())


@pytest.mark.parametrize("share", [0.001, 0.2])
def test_odd_rows(spark, documents, odd, share):
    """With a large share no key is frequent, so all go through the ranges; with a small one all do not."""
    assert got(documents(odd), share=share) == plain(odd)


def test_long_documents_and_a_frequent_line(spark, documents):
    rows = [(i, "\n".join(["the frequent line"] * (i % 3) + [f"line number {(i * k) % 90} of many" for k in range(200)])) for i in range(30)]
    for share in (0.001, 0.05, 0.9):
        assert got(documents(rows), share=share) == plain(rows)


@pytest.mark.parametrize("parts", [6_000, 100_000])
def test_many_partitions(spark, documents, parts):
    rows = [(i, f"a line that many have\nown line number {i}\n" + "lines of every third\n" * (i % 3 == 0)) for i in range(1, 1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = documents(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert got(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_million_lines_that_all_go(spark, documents):
    text = "\n".join(f"line number {i}" for i in range(1_000_000))
    rows = [(1, text), (2, text + "\nand its own end"), (3, "line number 999999\nstays here")]
    kept = linededup.apply_bitmaps(documents(rows), linededup.keep_bitmaps(documents(rows)))
    assert {r["doc_id"]: (r["n_dropped"], r["kept_text"][:99]) for r in kept.select("doc_id", "n_dropped", "kept_text").collect()} == {1: (0, text[:99]), 2: (1_000_000, "and its own end"), 3: (1, "stays here")}


def test_white_space_and_letters(spark, documents):
    rows = [(1, "ABCDEFGHIJ"), (2, "\x0babcdefghij\x0c"), (3, "\x85abcdefghij"), (4, "ÀBCDEFGHIJK"), (5, "àbcdefghijk"), (6, "Àbcdefghijk"), (7, "short"), (8, "short")]
    assert got(documents(rows)) == plain(rows)


def test_empty_table(spark, documents):
    assert got(documents([])) == []


def test_only_built_in_functions(spark, documents):
    df = documents([(1, "a line that is long enough")])
    plan = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow").split("Scan")[0]
