"""Hand-made rows for the rules that are easy to get wrong."""

import datetime as dt
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrel.functions import numbers, text
from spindrel.operators import atlas, engagement, graph, identity, maintain, orphans, research, search, serve, skew
from spindrel.session import checkpoint_dir
from spindrel.sources import files, publish
from spindrel.streaming import engagement as stream


def col(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, want", [("\t x ", "x"), ("　a b﻿", "a b"), ("", ""), (None, None)])
def test_strip(spark, value, want):
    assert col(spark, value, "string", text.strip) == want


@pytest.mark.parametrize("bare, want", [("whole", "abc"), ("empty", ""), ("null", None)])
def test_mailbox_without_at(spark, bare, want):
    assert col(spark, "Abc", "string", lambda c: text.mailbox(c, bare)) == want
    assert col(spark, " Abc@x.y", "string", lambda c: text.mailbox(c, bare)) == "abc"


def test_tokens(spark):
    assert col(spark, "AI/ML heat-transfer x", "string", text.tokens) == ["ai", "ml", "heat-transfer"]


@pytest.mark.parametrize("offered, want6, want55", [("alpha bravo charlie", True, True), ("alpha bravo", False, False)])
def test_title_fits(spark, offered, want6, want55):
    wanted = "alpha bravo charlie delta extra"
    assert col(spark, offered, "string", lambda c: text.title_fits(F.lit(wanted), c, 0.6)) is want6
    assert col(spark, offered, "string", lambda c: text.title_fits(F.lit(wanted), c, 0.55)) is want55
    assert col(spark, offered, "string", lambda c: text.title_fits(F.lit("a of it"), c)) is True


def test_synthetic_key_ignores_case_and_outer_blanks(spark):
    rows = spark.createDataFrame([("A Title ", 2020), (" a title", 2020), ("a title", None)], "t string, y int").select(text.synthetic_key(F.col("t"), F.col("y")).alias("k")).collect()
    assert rows[0]["k"] == rows[1]["k"] != rows[2]["k"]


def test_listed_once(spark):
    df = spark.createDataFrame([(["Soil", " soil ", "Air"], None, ["AIR", "x", "y", "z", "q", "r", "s", "t"])], "a array<string>, b array<string>, c array<string>")
    assert df.select(text.listed_once([F.col("a"), F.col("b"), F.col("c")]).alias("r")).first()["r"] == ["Soil", "Air", "x", "y", "z", "q", "r", "s"]
    empty = spark.createDataFrame([(None, [])], "a array<string>, b array<string>")
    assert empty.select(text.listed_once([F.col("a"), F.col("b")]).alias("r")).first()["r"] == []


def test_clamped_arguments():
    assert [numbers.clamp_arg(x, 1, 1) for x in (0, -1, "abc", None, "3")] == [1, 1, 1, 1, 3]
    assert [numbers.clamp_arg(x, 9, 1, 100) for x in (0, 500, "")] == [9, 100, 9]


def test_quantised(spark):
    values = [0.0, 1.0, 1.1, 0.5 / 65535, 1.5 / 65535]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(numbers.quantised(F.col("v"), F.lit(0.0), F.lit(1.0)).alias("q"))
    assert [r["q"] for r in df.collect()] == [0, 65535, 65535, 0, 2]


def test_shown_metrics(spark):
    df = spark.createDataFrame([(None, None), (5, None), (5, True), (5, False), (None, False)], "m int, v boolean")
    assert [r[0] for r in df.select(numbers.shown(F.col("m"), F.col("v"))).collect()] == [0, 5, 5, None, None]


DEPARTMENTS = [("65cfac3a8a79b26c2a250369", "Unit A", "AAA", "Department"), ("6b7ad8c09605a0e15e6a832e", "Unit B", "BBB", "Centre")]


def people(spark, rows):
    return spark.createDataFrame([(i, d, a) for i, d, a in rows], "faculty_id string, department string, affiliations array<string>")


def test_unit_references_in_every_notation(spark):
    deps = spark.createDataFrame(DEPARTMENTS, "dept_id string, name string, code string, category string")
    a = DEPARTMENTS[0][0]
    df = people(spark, [("1", a, []), ("2", f' ObjectId("{a.upper()}") ', []), ("3", "aaa", []), ("4", "ZZZ", []), ("5", None, None)])
    got = identity.with_unit(df.withColumn("unit_ref", orphans.reference_key(F.col("department"))), deps)
    assert sorted(r["faculty_id"] for r in got.collect()) == ["1", "2", "3"]


def test_memberships_once_per_unit(spark):
    deps = spark.createDataFrame(DEPARTMENTS, "dept_id string, name string, code string, category string")
    df = people(spark, [("1", "AAA", [DEPARTMENTS[1][0], DEPARTMENTS[0][0], "bbb"])])
    assert sorted(r["code"] for r in identity.memberships(df, deps).collect()) == ["AAA", "BBB"]


def test_h_index(spark):
    rows = [("a", c) for c in (10, 8, 5, 4, 3)] + [("b", 0), ("b", 0), ("c", None), ("c", 1)]
    df = spark.createDataFrame([([(i,)], c) for i, c in rows], "authors array<struct<author_id:string>>, citation_count int")
    assert {r["author_id"]: (r["n_papers"], r["n_citations"], r["h_index"]) for r in research.h_index(df).collect()} == {"a": (5, 30, 4), "b": (2, 0, 0), "c": (2, 1, 1)}


def test_facets_count_the_missing_year(spark):
    df = spark.createDataFrame([("k", 2020, "1"), ("k", 2020, "2"), ("k", None, "3")], "kerberos string, publication_year int, paper_id string")
    assert tuple(research.facets(df).first()) == ("k", 3, 2, 1)


def test_phrases(spark):
    df = spark.createDataFrame([("Carbon dioxide capture",), ("Carbon for carbon",), (None,)], "title string")
    assert [(r["term"], r["n"]) for r in search.phrases(df, "carbon", 9).collect()] == [("carbon", 3), ("carbon dioxide", 1), ("carbon dioxide capture", 1)]


def test_positions_are_dense(spark):
    df = spark.createDataFrame([(f"{i:05d}",) for i in random.Random(1).sample(range(1000), 500)], "paper_id string").repartition(7)
    got = [(r["i"], r["paper_id"]) for r in graph.positions(df).orderBy("i").collect()]
    assert got == list(enumerate(sorted(p for _, p in got)))
    assert graph.positions(df.limit(0)).count() == 0


def test_edges_repeat_nodes_do_not(spark):
    works = spark.createDataFrame([("p", "t", 2020, 1, "Th", "", "", "To")], "paper_id string, title string, publication_year int, citation_count int, theme string, domain string, subdomain string, topic string")
    owned = spark.createDataFrame([("p", "f"), ("p", "f")], "paper_id string, faculty_id string")
    edges = graph.graph_edges(owned, works)
    assert edges.count() == 8  # twice: author, theme, sub-domain stand-in, topic; no edge to an unknown domain
    assert graph.graph_nodes(edges).count() == 5


def brute_octree(points, capacity, max_depth):
    lo, hi = [], []
    for a in range(3):
        v = [p[1][a] for p in points]
        span = (max(v) - min(v)) or 1.0
        lo.append(min(v) - span * 1e-4)
        hi.append(max(v) + span * 1e-4)
    out, todo = {}, [("r", 0, lo, hi, points)]
    while todo:
        key, depth, lo, hi, pts = todo.pop()
        if len(pts) <= capacity or depth == max_depth:
            out.update({p[0]: key for p in pts})
            continue
        best = {}
        for p in pts:
            cell = tuple(max(0, min(15, int((p[1][a] - lo[a]) / ((hi[a] - lo[a]) or 1.0) * 16))) for a in range(3))
            if cell not in best or (p[2], -p[0]) > (best[cell][2], -best[cell][0]):
                best[cell] = p
        kept = sorted(best.values(), key=lambda p: (p[2], -p[0]), reverse=True)[:capacity]
        out.update({p[0]: key for p in kept})
        rest, mid = [p for p in pts if p[0] not in {k[0] for k in kept}], [(x + y) / 2 for x, y in zip(lo, hi)]
        for o in range(8):
            own = [p for p in rest if sum((p[1][a] >= mid[a]) << a for a in range(3)) == o]
            if own:
                todo.append((f"{key}-{o}", depth + 1, [mid[a] if o >> a & 1 else lo[a] for a in range(3)], [hi[a] if o >> a & 1 else mid[a] for a in range(3)], own))
    return out


def test_octree_equals_brute_force(spark):
    r = random.Random(3)
    points = [(i, (r.gauss(0, 1), r.gauss(0, 1), r.choice([0.0, 1.0])), r.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame([(i, *xyz, c, f"{i:024x}", "t", "d") for i, xyz, c in points], "i bigint, x double, y double, z double, citations int, paper_id string, theme string, domain string")
    placed = atlas.octree(df, capacity=20, max_depth=4)
    assert {x["i"]: x["node_key"] for x in placed.collect()} == brute_octree(points, 20, 4)
    box = atlas.bounds(df).first().asDict()
    made = atlas.tiles(placed, box, {"t": 0}, {"d": 0}).withColumn("said", atlas.tile_count()).collect()
    assert sum(t["n_points"] for t in made) == 300
    for t in made:
        assert len(t["payload"]) == 4 + 27 * t["n_points"] and struct.unpack("<I", t["payload"][:4])[0] == t["n_points"] == t["said"]
    assert atlas.octree(df.limit(0)).count() == 0


#: golden rows of the layout
CLOUD = [[0.35304, -0.33227, 0.6211], [-0.08364, -0.15696, -0.15624], [0.03207, 0.23667, 0.47919]]
CENTRES = {"a": [1.60562, 6.5325, -1.47088], "b": [-3.21124, 0.0, 2.94176], "c": [1.60562, -6.5325, -1.47088]}


def test_layout_is_seeded_by_id():
    assert atlas.cloud(pd.Series(["abc", "p1", ""]), np.array([1.0, 0.28, 2.0])).round(5).tolist() == CLOUD
    assert {k: [round(x, 5) for x in v] for k, v in atlas.theme_centres(atlas.blob_radii({"a": 100, "b": 50, "c": 1})).items()} == CENTRES
    centres = atlas.theme_centres({t: 1.2 for t in "abcdef"})
    names = sorted(centres)
    for a in range(3):
        assert abs(sum(c[a] for c in centres.values())) < 1e-9
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            assert sum((p - q) ** 2 for p, q in zip(centres[x], centres[y])) ** 0.5 >= 2.9


def test_likes_by_identity(spark):
    rows = [("u1", "a"), ("u1", "a"), (None, "b"), (None, "b"), ("u2", "b")]
    df = spark.createDataFrame([("c", u, ip) for u, ip in rows], "content string, user_id string, ip string")
    assert engagement.likes(df).count() == 3
    assert engagement.unliked(engagement.likes(df), df.filter("user_id = 'u1'")).count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a", 5), ("2", "b", 6)], "k string, name string, n int")
    new = spark.createDataFrame([("1", "", 7), ("3", "c", None)], "k string, name string, n int")
    got = {r["k"]: tuple(r)[1:] for r in maintain.upsert(old, new, "k", ["name", "n"]).collect()}
    assert got == {"1": ("a", 7, "update"), "2": ("b", 6, "none"), "3": ("c", None, "insert")}


def test_orphans_by_hand(spark):
    at = lambda y: dt.datetime(y, 1, 1)
    a, b = "a" * 24, "b" * 24
    refs = spark.createDataFrame([("f", f"p{i}", v, k, t) for i, (v, k, t) in enumerate([(a, a, at(2020)), (f" {a}", a, at(2010)), (a, a, at(2022)), (b, b, at(2020)), ("zz", "ZZ", at(2020)), (a, a, None), (a, a, at(2020))])], "ref_field string, paper_id string, ref_value string, key string, at timestamp_ntz")
    parents = spark.createDataFrame([("f", a, at(2015), at(2021)), ("f", a, at(2023), None)], "ref_field string, key string, born timestamp_ntz, gone timestamp_ntz")
    got = orphans.orphan_references(refs, parents)
    assert sorted(r["paper_id"] for r in got.collect()) == ["p1", "p2", "p3", "p4", "p5"]
    assert orphans.orphan_references(refs.limit(0), parents).count() == 0
    assert orphans.orphan_references(refs, parents.limit(0)).count() == 7
    months = {(r["ref_field"], r["month"]): r["n_references"] for r in orphans.orphan_counts(got).collect()}
    assert months["f", "2020-01"] == 2 and months["f", None] == 1


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), F.col("id").cast("string").alias("row"), F.lit("x").alias("_extra"))
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "key string, v int")
    got = skew.salted_lookup(rows, lookup, ["key"], "row", floor=100)
    want = rows.join(lookup, "key")
    assert got.count() == want.count() and got.select("row", "v").exceptAll(want.select("row", "v")).count() == 0
    assert skew.salted_lookup(rows, lookup, ["key"], "row", "left", floor=100).count() == 3000


def test_csv_and_headers(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'Kerb , DEPT code\r\n"a ""q""", AAA \r\n,\r\nb,"x\r\ny"\r\n')
    df = files.aliased(files.csv_table(spark, str(path)), {"kerberos": ("kerb",), "department_code": ("dept_code",)})
    assert [tuple(r) for r in df.collect()] == [('a "q"', "AAA"), ("b", "x\r\ny")] or [tuple(r) for r in df.collect()] == [('a "q"', "AAA"), ("b", "x\ny")]
    with pytest.raises(ValueError):
        files.aliased(df, {"email": ("mail",)})


def test_json_sources(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"a": 1}')
    (tmp_path / "one.json").write_text('{\n"a": 2}')
    assert [(r["a"], r["file_name"]) for r in files.json_folder(spark, str(tmp_path)).collect()] == [(2, "one.json")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "roster.json").write_text('{"departments": {"u": {"departmentId": "d", "sheetUnitName": "U", "facultyIds": ["1", "2"]}}}')
    assert files.roster(spark, str(tmp_path / "r")).count() == 2


def test_sheets(spark):
    a = spark.createDataFrame([("t", None)], "Title string, Topic string")
    got = files.sheets({"one": a, "two": a.select("Topic", "Title")}, ["Title", "Topic"]).collect()
    assert [tuple(r) for r in got] == [("one", "t", ""), ("two", "t", "")]
    with pytest.raises(ValueError):
        files.sheets({"one": a.drop("Topic")}, ["Title", "Topic"])


def test_authors(spark):
    assert col(spark, "A B, C D and E", "string", files.author_list) == ["A B", "C D", "E"]
    got = col(spark, ["a", "b", "c"], "array<string>", files.author_positions)
    assert [x["author_position"] for x in got] == ["first", "middle", "last"]
    assert [x["author_position"] for x in col(spark, ["a"], "array<string>", files.author_positions)] == ["first"]


def test_publish_and_collect(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    a, b = spark.range(3).toDF("i"), spark.range(5).toDF("i")
    assert publish.content_version(a) == publish.content_version(a.orderBy(F.col("i").desc())) != publish.content_version(b)
    for k, df in enumerate((a, b, a.union(b))):
        publish.publish({"t": df}, root, f"v{k}", f"2024-01-0{k + 1}")
    assert publish.active_version(spark, root) == "v2" and publish.read_active(spark, root, "t").count() == 8
    assert publish.collect_garbage(spark, root, ["t"], keep=2) == ["v0"]
    assert publish.read_active(spark, root, "t").count() == 8


def test_stream_counts_each_event_once(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 3, 5), 1, "click", 1.0, "{}") for i in range(9)]
    df = spark.createDataFrame(rows + rows[:4] + [(99, dt.datetime(2024, 1, 2), 1, "view", 1.0, "{}")], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream.run_to_table(stream.counts_by_window(stream.event_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["start"].hour, r["n"]) for r in got.filter("event_type = 'click'").collect()} == {(0, 3), (1, 3), (2, 3)}


def test_checkpoint_folder_is_the_sessions(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_fit_counts_tests_every_title(spark):
    r = random.Random(3)
    pool = ["soil", "soils", "layer", "layers", "calibrated", "uncalibrated", "retro", "retrofitting", "wave", "(wave)", "of", "the", "arid"]
    asked = [(f"s{i}", " ".join(r.choices(pool, k=r.randint(0, 7)))) for i in range(40)] + [("t", "Calibrated retrofitting of soil lyaers"), ("t", "Calibrated retrofitting of soil lyaers"), ("n", None), ("x", "zzzz")]
    given = [(f"p{i}", " ".join(r.choices(pool, k=r.randint(0, 7))).title()) for i in range(60)] + [("q", "Calibrated Retrofitting of Soil Layers [Article]"), ("q", "Calibrated Retrofitting of Soil Layers [Article]"), ("m", None)]
    want = {}
    for key, a in asked:
        for _, b in {g for g in given if g[1] is not None}:
            long = [w for w in (a or "").lower().split() if len(w) > 3]
            if a is not None and (not long or sum(w in b.lower() for w in long) / len(long) >= 0.6):
                want[key] = want.get(key, 0) + 1
    got = search.fit_counts(spark.createDataFrame(asked, "row_key string, title string"), spark.createDataFrame(given, "paper_id string, title string"))
    assert {x["row_key"]: x["n_fits"] for x in got.collect()} == want
    assert want["t"] >= 2 and "x" not in want
    assert search.fit_counts(got.select("row_key", F.lit("a").alias("title")), spark.createDataFrame([], "paper_id string, title string")).count() == 0


def test_refine_by_text_unit_or_person(spark):
    points = spark.createDataFrame([(i, "Soil" if i == 4 else "Ada Bo effects" if i == 5 else "x") for i in range(8)], "i bigint, title string").withColumns({c: F.lit("") for c in ("topic", "subdomain", "domain", "theme")})
    units = spark.createDataFrame([(0, "Polymer"), (1, "Polymer"), (2, "Polymer Growth"), (6, "Polymer")], "i bigint, unit_name string")
    people = spark.createDataFrame([(3, "f1", "Ada Bo"), (7, "f1", "Ada Bo"), (2, "f2", "Soila Ru")], "i bigint, faculty_id string, name string")
    tags = spark.createDataFrame([(0, " "), (1, "Crystal"), (6, "The Polymer unit")], "i bigint, department string")
    base = points.filter("i < 7")
    got = lambda q, **more: {r["i"] for r in search.refine(points, base, q, units, people, **more).collect()}
    assert got("ada bo") == {3} and got("ada") == {3, 5} and got("soil") == {2, 4} and got("soil", kind="faculty") == {2}
    assert got("Polymer", tags=tags) == {0, 6} and got("polymer") == {0, 1, 6}


def test_suggestions_offer_papers_by_abstract(spark):
    papers = spark.createDataFrame([("a", "Air", "soil and soil"), ("b", "Soil", None), ("c", "Water", "soil"), ("d", None, "air")], "paper_id string, title string, abstract string")
    points = spark.createDataFrame([(0, "a", "Air", "T"), (1, "b", "Soil", "T"), (2, "d", "", "T")], "i bigint, paper_id string, title string, theme string")
    assert [(r["paper_id"], r["score"]) for r in search.paper_hits(papers, points, "Soil").collect()] == [("b", 10), ("a", 2)]
    none = spark.createDataFrame([], "term string, n_papers bigint, unit_name string, n_faculty bigint, name string, h_index int")
    got = serve.suggestions(points, none, none, none, "soil", papers=papers).filter("kind = 'paper'").collect()
    assert [(r["text"], r["n"]) for r in got] == [("Soil", 10), ("Air", 2)]
