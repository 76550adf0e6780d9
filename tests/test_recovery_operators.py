"""Manifests, erasure with a restart, JSON payloads, Unicode and page tables."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import payloads
from factloom.operators import recovery
from factloom.sources import tables


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_manifest_shows_every_change(spark):
    data = [(1, "a", [1]), (1, "a", [1]), (2, None, None), (3, "", []), (4, "x|1:y", [2])]
    df = spark.createDataFrame(data, "k int, v string, l array<int>")
    digest = lambda x: rows(recovery.manifest({"t": x}), "n_rows", "digest_a", "digest_b")[0]
    base = digest(df)
    assert digest(df.repartition(3)) == base and digest(df.select("l", "v", "k")) == base
    for other in (data[:-1], [*data, data[0]], [(1, "a", [1]), (1, "a", [1]), (2, "", None), (3, None, []), data[4]], [(1, "b", [1]), *data[1:]], [(1, "a", [1]), (1, "a", [1]), (2, None, []), (3, "", None), data[4]]):
        assert digest(spark.createDataFrame(other, df.schema)) != base
    assert digest(df.limit(0)) == (0, "0", "0")
    two = recovery.manifest({"t": df}, {"w": ("t", F.col("v") == "a", "k"), "none": ("t", F.lit(False), "k")})
    report = recovery.verify_restore(two, recovery.manifest({"t": df.limit(0), "u": df}, {"w": ("t", F.lit(True), "k"), "none": ("t", F.lit(False), "k")}))
    assert rows(report, "name", "state") == [("none", "same"), ("t", "count_differs"), ("u", "added"), ("w", "count_differs")]


def test_erasure_needs_a_verified_manifest_and_goes_on_after_a_failure(spark, tmp_path):
    people = spark.createDataFrame([(1, "A", 1.5), (2, "B", None), (None, "C", 2.0), (1, "D", 3.0)], "id int, name string, x double")
    calls = spark.createDataFrame([(1, "p"), (3, "q")], "person int, body string")
    gone = spark.createDataFrame([(1,), (1,), (None,), (9,)], "who int")
    same = recovery.verify_restore(recovery.manifest({"people": people}), recovery.manifest({"people": people.repartition(2)}))
    bad = recovery.verify_restore(recovery.manifest({"people": people}), recovery.manifest({"people": people.limit(1)}))
    path = f"file://{tmp_path}/out"
    stages = lambda second: {"people": (people, "id", {"name": "[DELETED]", "x": None}), "calls": (second, "person", {"body": None})}
    for report in (bad, same.limit(0)):
        with pytest.raises(ValueError, match="verified"):
            recovery.erase_project(spark, path, stages(calls), gone, report)
    assert not (tmp_path / "out").exists()
    broken = calls.withColumn("body", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        recovery.erase_project(spark, path, stages(broken), gone, same)
    first = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out/people").iterdir()}
    out = recovery.erase_project(spark, path, stages(calls), gone, same)
    assert [r.asDict() for r in out.collect()] == [{"state": "deleted", "people_rows": 4, "people_erased": 2, "calls_rows": 2, "calls_erased": 1}]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out/people").iterdir()} == first
    people_now = spark.read.parquet(f"{path}/people")
    assert rows(people_now, "id", "name", "x") == sorted([(1, "[DELETED]", None), (1, "[DELETED]", None), (2, "B", None), (None, "C", 2.0)], key=repr)
    assert people_now.where("tombstone is not null").count() == 2 and people_now.select("tombstone").distinct().count() == 3
    assert recovery.erase_project(spark, path, stages(broken), gone, bad).count() == 1  # done already


def test_canonical_json(spark):
    cases = {
        '{"b": 129.0, "a": [1, {"z": null, "y": true}], "é": "\\u00e9\\n"}': '{"a":[1,{"y":true,"z":null}],"b":129,"é":"é\\n"}',
        "1e21": "1e+21", "1e16": "10000000000000000", "0.0000001": "1e-7", "0.000001": "0.000001", "-0.0": "0", "1.50": "1.5", "12345678901234567890": "12345678901234567000", "-2.5e-7": "-2.5e-7", "0.00001234": "0.00001234",
        ' "x" ': '"x"', "[]": "[]", "{}": "{}", "nope": None, "": None, '{"a":1,"a":2}': '{"a":2}',
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "j string")
    got = {r["j"]: (r["canonical"], r["digest"]) for r in payloads.canonical_json(df, "j").collect()}
    assert {k: v[0] for k, v in got.items() if k is not None} == cases
    assert got[None] == (None, None) and got["nope"][1].startswith("sha256:")


def test_redaction(spark):
    deep = json.loads("[" * 12 + '"sk_abcdefghijklmnop"' + "]" * 12)
    cases = [
        ({"token": {"a": 1}, "x": ["Bearer-abcdefghijkl and SK_ABCDEFGHIJKLM", 1, None], "My_API-Key": 5}, {"token": "[REDACTED]", "x": ["[REDACTED] and [REDACTED]", 1, None], "My_API-Key": "[REDACTED]"}, 4),
        (["sk_short"] * 150, ["sk_short"] * 100, 0),
        (deep, json.loads("[" * 9 + '"[TRUNCATED]"' + "]" * 9), 0),
        ("plain", "plain", 0),
    ]
    df = spark.createDataFrame([(n, json.dumps(a)) for n, (a, _, _) in enumerate(cases)] + [(90, "{broken"), (91, None), (92, "[" * 5000)], "n int, j string")
    got = {r["n"]: (r["redacted"], r["n_hits"]) for r in payloads.redacted_json(df, "j").collect()}
    for n, (_, want, hits) in enumerate(cases):
        assert json.loads(got[n][0]) == want and got[n][1] == hits
    assert got[90] == ('"[INVALID]"', 0) and got[91] == (None, None) and got[92] == ('"[INVALID]"', 0)


def test_nfkc(spark):
    df = spark.createDataFrame([("\ufb01\u2460\uff2b",), ("plain",), (None,), ("e\u0301",), ("",)], "t string")
    assert [r[0] for r in df.select(payloads.nfkc(F.col("t"))).collect()] == ["fi1K", "plain", None, "\u00e9", ""]


def test_tables_with_spans_and_nesting(spark):
    html = (
        "<table><thead><tr><th rowspan=2>A<th colspan='2'>B</thead><tr><th>b1<th>b2<tr><td rowspan='2'>1<td>2<td>3 <table><tr><td>in<p>ner</table>x<tr><td colspan=9999999>&lt;4</table>"
        "<td>stray</td><style><td>no</td></style><table><td>no row"
    )
    df = spark.createDataFrame([(1, html, "u"), (2, None, "u"), (3, "<p>", None), (4, "<table><tr><th>only", None)], "page_id int, html string, text2 string")
    cells = tables.table_cells(df).where("column_no < 4")
    assert rows(cells.where("table_no = 0 and page_id = 1"), "row_no", "column_no", "is_header", "text") == sorted(
        [(0, 0, True, "A"), (1, 0, True, "A"), (0, 1, True, "B"), (0, 2, True, "B"), (1, 1, True, "b1"), (1, 2, True, "b2"), (2, 0, False, "1"), (3, 0, False, "1"), (2, 1, False, "2"), (2, 2, False, "3 x"), *((3, c, False, "<4") for c in (1, 2, 3))], key=repr
    )
    assert rows(cells.where("table_no > 0"), "page_id", "table_no", "row_no", "column_no", "text") == [(1, 1, 0, 0, "in ner"), (1, 2, 0, 0, "no row")]
    assert rows(tables.table_records(cells, "page_id"), "row_no", "field", "text") == sorted([(2, "A", "1"), (3, "A", "1"), (2, "b1", "2"), (2, "b2", "3 x"), (3, "b1", "<4"), (3, "b2", "<4")], key=repr)


def test_pages_are_read_once_and_like_the_parser(spark):
    import random

    from factloom.plans import registry

    bits = ["<table>", "</table>", "<tr>", "<td>", "<th>", "</td>", "</tr>", "<td rowspan=2>", "<th colspan='3'>", '<TD ROWSPAN="2" class="a b">', "<b>", "</b>", "<p>", "text ", " &amp; "]
    odd = ["<br/>", "&am", "a > b", "< ", "<!-- <td> -->", "<!---->", "<!-->", "<!-- a--b -->", "<script>x='<td>'</script>", "<script>", "</script>", "<style>td{}</style>", "<!>", "<?pi>", "<!doctype html>", "<textarea><td></textarea>", "<a title='x>y'>", "</ td>", "<", "<td rowspan=0>", "<td rowspan=x>", "<script><!-- <script></script> -->", "<td colspan=2 colspan=3>"]
    made = random.Random(4)
    texts = ["<table>" * made.randrange(2) + "".join(made.choice(bits if made.random() < 0.8 else odd) for _ in range(made.randrange(1, 15))) for _ in range(3000)]
    for text in texts:
        assert tables.page_cells(text) == tables.read_page(text).cells, text
    # Cells of one place would leave the header open.
    texts = [t for t in texts if len({c[:3] for c in tables.page_cells(t)}) == len(tables.page_cells(t))][:400]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "page_id int, html string")
    names = ("page_id", "table_no", "row_no", "field", "text")
    got = rows(tables.page_records(df), *names)
    assert got and got == rows(tables.table_records(tables.table_cells(df), "page_id"), *names)

    plan = registry.QUERIES["src4_table_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_linked_data(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "N</b>"}, {"@type": ["A", "B"]}, 3]}</script><script type="application/LD+JSON">{bad</script><script>var x</script><script type="application/ld+json">{"x": 1}'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    got = rows(tables.linked_data(df), "page_id", "item_no", "item_type", "item")
    assert got == [(1, 0, "Product", '{"@type":"Product","name":"N</b>"}'), (1, 1, "A,B", '{"@type":["A","B"]}'), (1, 2, None, "3"), (1, 3, None, None)]


def test_dates_urls_and_quantities(spark):
    from factloom.functions import columns as C

    dates = {"2024-05-06": 1714953600.0, "2024-05-06T07:08": 1714979280.0, " 2024-05-06 07:08:09.5Z ": 1714979289.5, "2024-05-06T07:08:09+0200": 1714972089.0, "2024-05-06t07:08": None, "2024": None, "06/05/2024": None, "2024-13-01": None, "": None, "2024-05-06T07:08:09.123456-02:00": 1714986489.123456}
    df = spark.createDataFrame([(d,) for d in dates] + [(None,)], "d string")
    assert {r["d"]: r["t"] and r["t"].timestamp() for r in df.select("d", C.parse_date(F.col("d")).alias("t")).collect()} == dates | {None: None}
    urls = {"https://a.org/x": None, "https://A.ORG.": None, "http://a.org": "not_https", "https://u:p@a.org": "credentials", "https://10.example.org": "host_not_approved", "https://10.1.2.3": "private_host", "https://0.0.0.1:8": "private_host", "https://172.32.0.1": "host_not_approved", "https://x.localhost": "private_host", "https://[::1]/": "private_host", "https:///x": "private_host", "https://300.1.2.3": "host_not_approved"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["w"] for r in df.select("u", C.unsafe_url_reason(F.col("u"), ["a.org"]).alias("w")).collect()} == urls
    assert [r[0] for r in spark.createDataFrame([(2.0, "million_tokens"), (2.0, "tokens"), (2.0, None), (None, "tokens")], "n double, u string").select(C.tokens(F.col("n"), F.col("u"))).collect()] == [2e6, 2.0, None, None]


def test_ambiguous_keys_are_dealt_and_their_files_small(spark, monkeypatch, tmp_path):
    from factloom.operators import identity

    odd = spark.createDataFrame([("a", "k"), ("b", "k"), ("b", "k"), ("c", None), ("d", "one"), ("e", "none"), (None, "k")], "who string, key string")
    keyed = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2), ("k", None), ("one", 3), ("one", 3), (None, 4), (None, 5), ("free", 6), ("free", 7)], "key string, entity_id long")
    out = identity.ambiguous(odd, keyed, "key")
    assert out.columns == ["key", "who", "entity_id"]
    assert rows(out, "key", "who", "entity_id") == sorted([("k", w, e) for w in ("a", "b", "b", None) for e in (1, 2, None)], key=repr)

    inputs = spark.range(0, 300, 1, 1).select("id", F.lit(7).alias("key"))
    owners = spark.range(20_000).select(F.lit(7).alias("key"), F.col("id").alias("entity_id"))
    path = tmp_path / "pairs"
    identity.ambiguous(inputs, owners, "key").write.parquet(str(path))
    back = spark.read.parquet(str(path))
    assert back.agg(F.count_distinct("id"), F.count_distinct("entity_id"), F.count("*")).first()[:] == (300, 20_000, 6_000_000)
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < 0.5 * 6_000_000

    for name, n in (("SLICE", 32), ("LIST", 16), ("ROWS", 20_000)):
        monkeypatch.setattr(identity, name, n, raising=False)
    few = owners.where("entity_id < 700")
    dealt = identity.ambiguous(inputs, few, "key")
    assert dealt.distinct().count() == dealt.count() == 300 * 700
    per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 300 * 700 and max(per_task) < 300 * 700 // 2
