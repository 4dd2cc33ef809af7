"""Catalogue, maintenance, cache and file rules on hand-made rows."""

import zipfile

import pytest
from pyspark.sql import functions as F

from spindrel.functions import numbers
from spindrel.operators import catalog, directory, engagement, maintain, serve, skew
from spindrel.sources import cache, files, publish

CATALOG = "paper_id string, title string, theme string, domain string, subdomain string, topic string, document_type string, year int, citation_count int, author_ids array<string>"


@pytest.fixture
def papers(spark):
    rows = [
        ("p1", "Soil membrane, soil", "T", "D", "", "", "Article", 2020, 9, ["a"]), ("p2", "Soil", "T", None, "", "", "Review", None, None, None), ("p3", "Membrane reefs", "", "D", "", "soil", "Article", 2024, 9, ["a", "b"]), ("p4", None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, CATALOG)


def test_search_filters_sorts_and_pages(papers):
    ids = lambda df: [r["paper_id"] for r in df.collect()]
    assert ids(catalog.found_page(catalog.hits(papers, "soil membrane"))) == ["p1", "p3", "p2"]
    assert ids(catalog.found_page(catalog.hits(papers, "soil membrane", basic=True))) == ["p1", "p3"]
    assert ids(catalog.found_page(catalog.hits(papers, ""), "date")) == ["p3", "p1", "p2", "p4"]
    assert ids(catalog.found_page(catalog.hits(papers, ""), "normalized", current_year=2026)) == ["p3", "p1", "p2", "p4"]
    assert ids(catalog.found_page(catalog.hits(papers, ""), "citations", 2, 2)) == ["p2", "p4"]
    assert ids(catalog.hits(papers, "", catalog.Filters(years=(2021, None), author_id="b"))) == ["p3"]
    assert ids(catalog.hits(papers, "", catalog.Filters(refinements=("soil", "reef")))) == ["p3"]
    assert catalog.hits(papers.limit(0), "soil").count() == 0
    facets = {(r["facet"], r["value"]): r["n"] for r in catalog.facet_counts(papers).collect()}
    assert facets["kind", "Article"] == 2 and facets["theme", "T"] == 2 and ("year", None) not in facets


def test_years_out_of_range_have_no_papers(spark):
    points = spark.createDataFrame([(0, 1850), (1, 1950), (2, None)], "i bigint, year int")
    assert [r["i"] for r in catalog.since(points, 1900, 2026).collect()] == [1]
    assert catalog.since(points, 1899, 2026).count() == 0 and catalog.since(points, 2028, 2026).count() == 0


def test_profile_papers_stored_first(spark):
    persons = spark.createDataFrame([("f1", "a", ["s1"]), ("f2", "b", ["", "s2"]), ("f3", "c", None)], "faculty_id string, kerberos string, google_scholar_id array<string>")
    works = spark.createDataFrame([("scholar_1", "A", "Stored", 2020, None), ("2-s2.0-1", "b", "Other", 2020, 1)], "document_eid string, kerberos string, title string, publication_year int, citation_count int")
    profiles = spark.createDataFrame([("s1", "Not asked", 2019, 1), ("s2", "Fetched", None, None)], "scholar_id string, title string, year int, citations int")
    got = {(r["faculty_id"], r["source"], r["title"], r["citations"]) for r in catalog.profile_papers(persons, works, profiles).collect()}
    assert got == {("f1", "stored", "Stored", 0), ("f2", "fetched", "Fetched", 0)}


def test_small_rules(spark):
    one = lambda e, v, t: spark.createDataFrame([(v,)], f"v {t}").select(e(F.col("v")).alias("r")).first()["r"]
    for text, want in (("1,234", 1234), (" 7 ", 7), ("x", -1), (None, -1), ("", -1), ("12345678901", -1)):
        assert one(lambda c: numbers.tolerant_int(c, -1), text, "string") == want
    assert one(catalog.clean_id, "a-b_1'); DROP", "string") == "a-b_1DROP"
    assert one(lambda c: catalog.clipped(c, 4), "abcdef", "string") == "abcd" and one(lambda c: catalog.clipped(c, 4), None, "string") == "    "
    assert one(catalog.plain_title, "  A: b-C! é ", "string") == "a b c"
    assert one(catalog.digest_key, ["b", "a"], "array<string>") == one(catalog.digest_key, ["a", "b"], "array<string>")
    assert [numbers.clamp_arg(x, 5, 1, 20) for x in (None, "0", "-3", "99", "7")] == [5, 5, 1, 20, 7]
    assert directory.pagination(19, 2, 9) == {"page": 2, "limit": 9, "total": 19, "totalPages": 3, "hasNext": True, "hasPrev": True}
    assert one(numbers.rounded, 0.25, "double") == 0.2


def test_plans(spark):
    persons = spark.createDataFrame([("f1", "Ab@x.y", 1), ("f2", None, 2)], "faculty_id string, email string, h_index int")
    changes = spark.createDataFrame([("AB", 5), ("ab", None), ("", 9), (None, 9)], "kerberos string, h_index int")
    assert {r["faculty_id"]: (r["h_index"], r["changed"]) for r in maintain.set_by_mailbox(persons, changes, ["h_index"]).collect()} == {"f1": (5, True), "f2": (2, False)}
    deps = spark.createDataFrame([("d1", "AA", "A", "Centre")], "dept_id string, code string, name string, category string")
    wanted = spark.createDataFrame([("aa", "A", "Centre", True), ("BB", "B", "Centre", True), ("CC", "C", "Centre", False), ("aa ", "A2", "Centre", True)], "code string, name string, category string, may_create boolean")
    assert sorted((r["code"], r["action"]) for r in maintain.unit_sync(wanted, deps).collect()) == [("AA", "none"), ("AA", "update"), ("BB", "create"), ("CC", "skip")]
    assert {(r["code"], r["dept_id"], r["category"]) for r in maintain.recategorised(deps, {"aa": "Other", "zz": "Other"}).collect()} == {("AA", "d1", "Other"), ("zz", None, "Other")}
    rows = spark.createDataFrame([("d1", "f1"), ("d1", "f2"), ("d2", "f3")], "dept_id string, faculty_id string")
    roster = spark.createDataFrame([("D1", "F1"), ("D1", "F1")], "dept_id string, faculty_id string")
    assert {tuple(r) for r in maintain.on_roster(rows, roster).collect()} == {("d1", "f1"), ("d2", "f3")}
    assert maintain.on_roster(rows, roster.limit(0)).count() == 3
    report = maintain.report({"a": rows, "b": rows.limit(0)}, "faculty_id").collect()
    assert len(report) == 3 and report[0]["detail"] == '{"dept_id":"d1","faculty_id":"f1"}'


def test_cache(spark, tmp_path):
    now, calls = [0.0], []

    def build(n):
        calls.append(n)
        return None if n is None else spark.range(n)

    import time

    kept = cache.Cache(spark, str(tmp_path), lambda: time.time() + now[0])
    assert kept.get("search:a", lambda: build(3)).count() == 3 and kept.get("search:a", lambda: build(4)).count() == 3
    now[0] = 301
    assert kept.get("search:a", lambda: build(4)).count() == 4
    kept.forget("search")
    assert kept.get("search:a", lambda: build(5), 10**6).count() == 5
    assert kept.get("graph:x", lambda: build(None)) is None and kept.get("graph:x", lambda: build(1)).count() == 1  # the miss has grown old
    kept.warm({"graph:y": lambda: build(2)})
    assert kept.get("graph:y", lambda: build(9), 10**6).count() == 2 and calls == [3, 4, 5, None, 1, 2]
    assert cache.if_changed(b"x", cache.content_tag(b"x")) is None and cache.if_changed(b"x", "old") == b"x"
    reads = []
    read = cache.tile_reader(lambda v, k: reads.append(k) or b"t", 2)
    assert [read("v", k) for k in "aab"] == [b"t"] * 3 and reads == ["a", "b"]


def test_workbook_and_headers(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Dept</t></si><si><t>Name</t></si><si><r><t>A</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7</v></c></row><row><c r="C3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    book = files.workbook(spark, path)
    assert [tuple(r) for r in book["S1"].collect()] == [("Ab", "7"), (None, "x")]
    assert [(r["department"], r["names"]) for r in files.names_by_department(book["S1"], "Dept", "Name").collect()] == [("Ab", ["7"])]
    df = spark.createDataFrame([("1", "k", "d")], "id string, kerberos string, dept string")
    assert files.aliased(df).first()["kerberos"] == "1"  # the first column of the table with any of the aliases
    with pytest.raises(ValueError):
        files.aliased(df.drop("dept"))


def test_reads_nobody_called(spark):
    assert serve.first_existing(spark, ["no_such_table"]) is None
    spark.range(1).createOrReplaceTempView("there_is")
    assert serve.first_existing(spark, ["no_such_table", "there_is"]) == "there_is"
    works = spark.createDataFrame([("p1", "Deep soil water", None, "https://doi.org/10.1/x"), ("p2", "Deep soil water", None, None)], "paper_id string, title string, abstract string, link string")
    assert callable(engagement.may_delete) and works.count() == 2


def test_documents_are_written_with_an_index(spark, tmp_path):
    edges = spark.createDataFrame([("f1", "f:f1", "p:1", "AUTHORED")], "faculty_id string, source string, target string, label string")
    nodes = spark.createDataFrame([("f1", "f:f1", "faculty"), ("f1", "p:1", "paper"), ("f2", "f:f2", "faculty")], "faculty_id string, node_id string, kind string")
    publish.write_documents(publish.person_documents(nodes, edges), "faculty_id", str(tmp_path))
    assert spark.read.text(f"{tmp_path}/documents").count() == 2
    assert {r["faculty_id"]: r["n_nodes"] for r in spark.read.json(f"{tmp_path}/index").collect()} == {"f1": 2, "f2": 1}


def test_hot_keys_are_cut_by_their_rows(spark):
    counts = spark.createDataFrame([("a", 50_000), ("b", 20_001), ("c", 3)], "k string, _n bigint")
    assert {r["k"]: r["_pieces"] for r in skew.hot_keys(counts, ["k"]).collect()} == {"a": 3, "b": 2}
    rows = spark.range(300).select(F.when(F.col("id") < 250, "a").otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id")
    lookup = rows.select("k").distinct().withColumn("v", F.length("k"))
    assert skew.salted_lookup(rows, lookup, ["k"], "id", floor=10).count() == 300
    assert skew.salted_lookup(rows, lookup.filter("k = 'a'"), ["k"], "id", "left", floor=10).filter("v IS NULL").count() == 50
    assert skew.salted_lookup(rows.limit(0), lookup, ["k"], "id").count() == 0
