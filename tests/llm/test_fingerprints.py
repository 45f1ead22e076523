from weftgraph.llm import fingerprints as fp


def phrases(text):
    seen, at, end = set(), 0, 1
    while end <= len(text):
        if text[at:end] not in seen:
            seen.add(text[at:end])
            at = end
        end += 1
    return seen


def plain(rows, size=fp.SIZE):
    return sorted(map(str, plain_rows(rows, size)))


def plain_rows(rows, size=fp.SIZE):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) - len(text) // 4
        edited = text[:cut] + after[: len(text) - cut]
        a, b, c = (fp.signature(phrases(t), size) for t in (text, edited, after))
        out.append((i, len(text), edited, fp._hex(a), fp._hex(b), round(fp.likeness(a, b, size), 9), round(fp.likeness(a, c, size), 9)))
    return out


def got(df):
    return sorted(str((*r[:5], round(r[5], 9), round(r[6], 9))) for r in fp.edit_probe(df).collect())


def test_parse_in_parts_is_the_whole_parse():
    text = "abracadabra abracadabra " * 20
    for cut in (0, 1, 7, 100, len(text)):
        assert fp.Parse().feed(text[:cut]).feed(text[cut:]).seen == phrases(text)


def test_odd_rows(spark, documents, odd):
    assert got(documents(odd)) == plain(odd)


def test_ids_far_apart_and_one_row(spark, documents):
    rows = [(i * i * 1_000_003 - 500, f"text {i} " * (i + 1)) for i in range(40)]
    assert got(documents(rows)) == plain(rows)
    assert got(documents(rows[:1])) == plain(rows[:1])
    assert got(documents([])) == []
    assert got(documents([(None, "a b c"), (None, "d e f g h")])) == plain([(None, "a b c"), (None, "d e f g h")])


def test_fingerprints(spark, documents):
    rows = fp.fingerprints(documents([(1, "same text"), (2, "same text"), (3, None), (4, "other")])).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert by[1] == by[2] != by[4] and by[3] == ""


def test_likeness():
    a, b = (fp.signature(phrases(t)) for t in ("the cat sat on the mat " * 20, "colourless green ideas sleep " * 20))
    none = fp.signature(set())
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.3 and fp.likeness(a, none) == 0 and fp.likeness(none, none) == 1


def test_hashes_do_not_depend_on_order_or_place():
    p = {"a", "ab", "abc", "\U0001f600", "é"}
    assert sorted(fp.phrase_hashes(p).tolist()) == sorted(h for x in p for h in fp.phrase_hashes({x}).tolist())
    assert len(set(fp.phrase_hashes({f"p{i}" for i in range(5000)}).tolist())) == 5000


def test_ids_of_any_ordered_type(spark):
    """Text ids and dates make ranges too; ties and missing ids as with numbers."""
    words = ["one two", "two three two", "", "three one one one", "abc " * 50, "Zz zz"]
    rows = [(f"id-{i * 7 % 40:02d}-\u00e9", words[i % 6] + str(i)) for i in range(40)] + [(None, "no id"), ("id-05-\u00e9", "again")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    found = got(df)
    assert found == sorted(map(str, plain_by(rows)))
    days = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "n int, text string").selectExpr("date_add(date'2020-01-01', n) doc_id", "text")
    assert sorted(r["near_next"] for r in fp.edit_probe(days).collect()) == sorted(r["near_next"] for r in fp.edit_probe(days.selectExpr("datediff(doc_id, date'2020-01-01') doc_id", "text")).collect())
    assert fp.edit_probe(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def plain_by(rows):
    """plain() for ids of another type: numbers in their order, then the ids themselves again."""
    ids = sorted({i for i, _ in rows if i is not None})
    numbered = plain_rows([(None if i is None else ids.index(i) + 1, t) for i, t in rows])
    return [(None if r[0] is None else ids[r[0] - 1], *r[1:]) for r in numbered]


def test_texts_are_read_once(spark, documents, tmp_path):
    """Texts are the bulk: they are scanned once, and no Python worker takes part in finding successors."""
    rows = [(i // 2, f"text {i} " * (i % 7)) for i in range(60)] + [(None, "no id")]
    documents(rows).repartition(3).write.parquet(str(tmp_path / "d"))
    probed = fp.edit_probe(spark.read.parquet(str(tmp_path / "d")))
    assert got(spark.read.parquet(str(tmp_path / "d"))) == plain(rows)
    plan = probed._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert sum("text:string" in line for line in scans) == 1
    assert "Scan ExistingRDD" not in plan and plan.count("MapInArrow") == 1


def test_local_times_that_occur_twice_are_ids_too(spark):
    """Where a time without zone names two instants, its range still finds its successor."""
    df = spark.range(90).selectExpr("timestamp_ntz'2020-11-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 2 as int), 0) doc_id", "repeat(cast(id as string), 20) text")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert fp.edit_probe(df).count() == 90
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
