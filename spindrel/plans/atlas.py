"""Queries and SQL over graphs, the explorer, the atlas, text functions, and engagement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import atlas, engagement, graph, maintain, search
from .roles import FILLED, OWNED, PEOPLE, WORKS, Roles, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if oracle:
            SQL[name] = oracle
        return f

    return keep


# graphs and the explorer

_EDGES = """edges AS (
  SELECT faculty_id, 'f:' || faculty_id AS source, 'p:' || paper_id AS target, 'AUTHORED' AS label FROM own JOIN filled USING (paper_id)
  UNION ALL SELECT faculty_id, 'p:' || paper_id, 'theme:' || theme, 'BELONGS_TO' FROM own JOIN filled USING (paper_id) WHERE theme NOT IN ('Unclassified', 'Unknown Domain')
  UNION ALL SELECT faculty_id, 'p:' || paper_id, 'dom:' || domain, 'IN_DOMAIN' FROM own JOIN filled USING (paper_id) WHERE domain NOT IN ('Unclassified', 'Unknown Domain')
  UNION ALL SELECT faculty_id, 'p:' || paper_id, 'sd:' || subdomain, 'IN_SUBDOMAIN' FROM own JOIN filled USING (paper_id) WHERE subdomain NOT IN ('Unclassified', 'Unknown Domain')
  UNION ALL SELECT faculty_id, 'p:' || paper_id, 'topic:' || topic, 'HAS_TOPIC' FROM own JOIN filled USING (paper_id) WHERE topic NOT IN ('Unclassified', 'Unknown Domain')),
nodes AS (SELECT faculty_id, n AS node_id, CASE split_part(n, ':', 1) WHEN 'f' THEN 'faculty' WHEN 'p' THEN 'paper' WHEN 'theme' THEN 'theme' WHEN 'dom' THEN 'domain' WHEN 'sd' THEN 'subdomain' ELSE 'topic' END AS kind
  FROM (SELECT faculty_id, source AS n FROM edges UNION SELECT faculty_id, target FROM edges))"""
_G = (PEOPLE, WORKS, OWNED, FILLED)


@query("authorship", sql(PEOPLE, WORKS, OWNED, body="SELECT paper_id, faculty_id FROM own"))
def _(r: Roles):
    return r.owned


@query("graph_edges", sql(*_G, _EDGES, body="SELECT * FROM edges"))
def _(r: Roles):
    return graph.graph_edges(r.owned, r.labelled_works)


@query("graph_nodes", sql(*_G, _EDGES, body="SELECT * FROM nodes"))
def _(r: Roles):
    return graph.graph_nodes(graph.graph_edges(r.owned, r.labelled_works))


@query(
    "graph_stats",
    sql(*_G, _EDGES, body="""SELECT * FROM (SELECT faculty_id, count(*) AS n_nodes, count(*) FILTER (WHERE kind = 'paper') AS n_papers FROM nodes GROUP BY ALL)
  JOIN (SELECT faculty_id, count(*) AS n_edges, count(*) FILTER (WHERE label = 'IN_DOMAIN') AS n_classified FROM edges GROUP BY ALL) USING (faculty_id)"""),
)
def _(r: Roles):
    edges = graph.graph_edges(r.owned, r.labelled_works)
    return graph.graph_stats(graph.graph_nodes(edges), edges)


_CELLS = """terms AS (SELECT paper_id, 'theme' AS type, theme AS term FROM filled UNION ALL SELECT paper_id, 'domain', domain FROM filled UNION ALL SELECT paper_id, 'subdomain', subdomain FROM filled UNION ALL SELECT paper_id, 'topic', topic FROM filled),
cells AS (SELECT type, term, unit_name, faculty_id, count(*) AS n_papers FROM own JOIN terms USING (paper_id) JOIN home USING (faculty_id)
  WHERE term NOT IN ('Unclassified', 'Research Topic', 'Unknown Theme', 'Unknown Domain', 'Unknown Sub-Domain', 'Unknown Dept') GROUP BY ALL)"""
_TERMS = "SELECT type, term, CAST(sum(n_papers) AS BIGINT) AS n_papers, count(DISTINCT unit_name) AS n_units, count(*) AS n_faculty FROM cells GROUP BY ALL"


def _cells(r: Roles):
    return graph.term_cells(r.owned, r.labelled_works, r.homes)


@query("explore_detail", sql(*_G, _CELLS, body="SELECT type, term, unit_name, CAST(sum(n_papers) AS BIGINT) AS n_papers, count(*) AS n_faculty, string_agg(faculty_id, ',' ORDER BY n_papers DESC, faculty_id) AS faculty_ids FROM cells GROUP BY ALL"))
def _(r: Roles):
    return graph.explore_detail(_cells(r))


@query("explore_terms", sql(*_G, _CELLS, body=_TERMS))
def _(r: Roles):
    return graph.explore_terms(_cells(r))


@query("explore_list", sql(*_G, _CELLS, body=f"SELECT * FROM ({_TERMS}) WHERE contains(lower(term), 'ing') ORDER BY CASE type WHEN 'theme' THEN 0 WHEN 'domain' THEN 1 WHEN 'subdomain' THEN 2 ELSE 3 END, n_papers DESC, term LIMIT 40"))
def _(r: Roles):
    return graph.list_terms(graph.explore_terms(_cells(r)), "ing")




@query("faculty_indices", sql(PEOPLE, WORKS, OWNED, body="SELECT faculty_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices FROM own JOIN place USING (paper_id) GROUP BY ALL"))
def _(r: Roles):
    return graph.indices_of(r.owned, r.places, "faculty_id")


@query("unit_indices", sql(PEOPLE, WORKS, OWNED, body="SELECT unit_name, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices FROM (SELECT DISTINCT unit_name, i FROM own JOIN home USING (faculty_id) JOIN place USING (paper_id)) GROUP BY ALL"))
def _(r: Roles):
    return graph.indices_of(r.owned.join(r.homes, "faculty_id"), r.places, "unit_name")


@query("paper_positions", sql(WORKS, body="SELECT i, paper_id FROM place"))
def _(r: Roles):
    return r.places


@query("year_indices", sql(WORKS, body="SELECT i FROM pap JOIN place USING (paper_id) WHERE publication_year >= 2023"))
def _(r: Roles):
    return r.points.filter("year >= 2023").select("i")


@query("index_union", sql(PEOPLE, WORKS, OWNED, body="SELECT DISTINCT i FROM own JOIN home USING (faculty_id) JOIN place USING (paper_id) WHERE unit_name IN ('Department of Polymer Dynamics', 'School of Sound Archives')"))
def _(r: Roles):
    units = r.unit_points
    return graph.union_of([units.filter(F.col("unit_name") == n) for n in ("Department of Polymer Dynamics", "School of Sound Archives")])


# searching

_POINT = "pt AS (SELECT i, l.paper_id, title, topic, subdomain, domain, theme, publication_year AS year, citation_count FROM lab l JOIN place USING (paper_id))"
_HOLDS = lambda q: "(" + " OR ".join(f"contains(lower({c}), '{q}')" for c in search.FIELDS) + ")"


@query("atlas_search_words", sql(WORKS, _POINT, body=f"SELECT i, paper_id, CAST(0 AS INTEGER) AS score FROM pt WHERE {_HOLDS('membrane')} AND {_HOLDS('samp')} ORDER BY i LIMIT 70000"))
def _(r: Roles):
    return search.search(r.points, "Membrane samp", 70_000)


_S = " + ".join(f"len(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}-]+'), lambda t: t = 'membrane')) * {w}" for c, w in search.WEIGHTS.items())


@query("atlas_search_word", sql(WORKS, _POINT, body=f"SELECT i, paper_id, CAST({_S} AS INTEGER) AS score FROM pt WHERE {_S} > 0 ORDER BY score DESC, i LIMIT 70000"))
def _(r: Roles):
    return search.search(r.points, "membrane", 70_000)


@query("theme_search", sql(WORKS, _POINT, body=f"SELECT i FROM pt WHERE theme = 'Energy and Mobility' AND {_HOLDS('soil layers')}"))
def _(r: Roles):
    return search.in_theme(r.points, "Energy and Mobility", "soil layers").select("i")


_UNIT_POINT = "up AS (SELECT DISTINCT i, unit_name FROM own JOIN home USING (faculty_id) JOIN place USING (paper_id))"


@query("refine_within_unit", sql(PEOPLE, WORKS, OWNED, _POINT, _UNIT_POINT, body=f"SELECT i FROM (SELECT i FROM pt WHERE {_HOLDS('comp')} UNION SELECT i FROM up WHERE contains(lower(unit_name), 'comp')) WHERE i IN (SELECT i FROM up WHERE unit_name = 'Department of Polymer Dynamics' UNION SELECT i FROM up WHERE unit_name = 'Visual Computing Laboratory')"))
def _(r: Roles):
    units = r.unit_points
    base = units.filter(F.col("unit_name").isin("Department of Polymer Dynamics", "Visual Computing Laboratory"))
    return search.refine(r.points, base, "comp", units)


@query("refine_by_person", sql(PEOPLE, WORKS, OWNED, _POINT, _UNIT_POINT, body=f"SELECT i FROM (SELECT i FROM pt WHERE {_HOLDS('ru')} UNION SELECT i FROM up WHERE contains(lower(unit_name), 'ru') UNION SELECT i FROM own JOIN fac USING (faculty_id) JOIN place USING (paper_id) WHERE contains(lower(full_name), 'ru')) WHERE i IN (SELECT i FROM up WHERE unit_name = 'Department of Polymer Dynamics')"))
def _(r: Roles):
    units = r.unit_points
    people_points = r.owned.join(r.people.select("faculty_id", "name"), "faculty_id").join(r.places, "paper_id").select("i", "faculty_id", "name")
    return search.refine(r.points, units.filter("unit_name = 'Department of Polymer Dynamics'"), "ru", units, people_points)


_PHRASES = """w AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM pap),
s AS (SELECT w[k] AS a, coalesce(w[k + 1], '') AS b, coalesce(w[k + 2], '') AS c FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM w) WHERE starts_with(w[k], 'mem') AND length(w[k]) >= 2),
g AS (SELECT *, length(b) >= 2 AND b NOT IN ({0}) AS gb, length(c) >= 2 AND c NOT IN ({0}) AS gc FROM s)""".format(", ".join(f"'{x}'" for x in text.PHRASE_STOPWORDS))


@query("keyword_phrases", sql(WORKS, _PHRASES, body="SELECT * FROM (SELECT term, count(*) AS n FROM (SELECT a AS term FROM g UNION ALL SELECT a || ' ' || b FROM g WHERE gb UNION ALL SELECT a || ' ' || b || ' ' || c FROM g WHERE gb AND gc) GROUP BY ALL) ORDER BY n DESC, length(term), term LIMIT 12"))
def _(r: Roles):
    return search.phrases(r.works, "thin mem", 12)


@query("related_themes", sql(WORKS, _POINT, body="SELECT theme, count(*) AS n_papers FROM pt WHERE contains(lower(title), 'alloy') AND theme <> '' GROUP BY ALL ORDER BY n_papers DESC, theme LIMIT 8"))
def _(r: Roles):
    return search.related(r.points, "alloy")


@query("cluster_breakdown", sql(PEOPLE, WORKS, OWNED, _POINT, _UNIT_POINT, body=f"SELECT coalesce(unit_name, 'Unassigned') AS unit_name, count(*) AS n_papers, CAST(sum(coalesce(citation_count, 0)) AS BIGINT) AS n_citations, min(i) AS first_i FROM (SELECT * FROM pt WHERE theme = 'Food and Energy' AND {_HOLDS('layers')}) LEFT JOIN up USING (i) GROUP BY ALL"))
def _(r: Roles):
    return search.breakdown(r.points, r.unit_points, "Food and Energy", "layers")


@query("paper_meta", sql(PEOPLE, WORKS, OWNED, body="SELECT p.paper_id, coalesce(p.title, '') AS title, coalesce(p.citation_count, 0) AS citation_count, coalesce(len(p.authors), 0)::BIGINT AS n_authors, coalesce(string_agg(o.faculty_id, ',' ORDER BY o.faculty_id), '') AS people FROM pap p LEFT JOIN own o USING (paper_id) GROUP BY ALL"))
def _(r: Roles):
    people = r.owned.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("faculty_id")), ",").alias("people"))
    return r.works.select("paper_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.coalesce(F.size("authors"), F.lit(0)).cast("bigint").alias("n_authors")).join(people, "paper_id", "left").withColumn("people", F.coalesce("people", F.lit("")))


@query("taxonomy_counts", sql(PEOPLE, WORKS, OWNED, body="SELECT theme, domain, count(DISTINCT paper_id) AS n_papers, count(DISTINCT faculty_id) AS n_faculty FROM lab LEFT JOIN own USING (paper_id) WHERE theme <> '' GROUP BY ALL"))
def _(r: Roles):
    w = r.labelled_works.filter("theme <> ''").select("paper_id", "theme", "domain")
    return w.join(r.owned, "paper_id", "left").groupBy("theme", "domain").agg(F.countDistinct("paper_id").alias("n_papers"), F.countDistinct("faculty_id").alias("n_faculty"))


@query("similar_vectors", "SELECT query_id, vec_id, cosine, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5")
def _(r: Roles):
    v = r.t("embeddings").select("vec_id", "embedding")
    return search.similar(v, v.filter("vec_id % 50 = 0"))


# the spreadsheet, ids and years


@query("first_sheet_rows", "SELECT MongoDB_ID, row_key, Title AS title FROM build_kg WHERE trim(MongoDB_ID) <> '' QUALIFY row_number() OVER (PARTITION BY MongoDB_ID ORDER BY row_key) = 1")
def _(r: Roles):
    return graph.first_rows(r.t("build_kg"), "MongoDB_ID", "row_key").select("MongoDB_ID", "row_key", F.col("Title").alias("title"))


@query("missing_papers", "SELECT DISTINCT lower(trim(MongoDB_ID)) AS paper_id FROM build_kg WHERE trim(MongoDB_ID) <> '' AND lower(trim(MongoDB_ID)) NOT IN (SELECT lower(paper_id) FROM researchmetadatascopus)")
def _(r: Roles):
    wanted = r.t("build_kg").filter("trim(MongoDB_ID) <> ''").select(F.lower(F.trim("MongoDB_ID")).alias("paper_id")).distinct()
    return wanted.join(r.t("researchmetadatascopus").select(F.lower("paper_id").alias("paper_id")), "paper_id", "left_anti")


@query("resolve_author_ids", sql(PEOPLE, body="SELECT author_id, faculty_id FROM (SELECT unnest(scopus_id) AS author_id, faculty_id FROM fac) QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY faculty_id DESC) = 1"))
def _(r: Roles):
    return maintain.last_writer(r.people.select(F.explode("scopus_id").alias("author_id"), "faculty_id"), "author_id", "faculty_id")


# text functions over whole tables


@query("synthetic_keys", sql(WORKS, body=r"SELECT paper_id, 'scholar_' || substr(md5(lower(regexp_replace(coalesce(title, ''), '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g')) || '_' || coalesce(publication_year::VARCHAR, '')), 1, 16) AS key, ('0x' || substr(md5('id:' || paper_id), 1, 8))::BIGINT AS seed FROM pap"))
def _(r: Roles):
    seed = F.conv(F.substring(F.md5(F.concat(F.lit("id:"), "paper_id")), 1, 8), 16, 10).cast("bigint")
    return r.works.select("paper_id", text.synthetic_key(F.col("title"), F.col("publication_year")).alias("key"), seed.alias("seed"))


@query("doi_of_links", sql(WORKS, body="SELECT paper_id, nullif(regexp_extract(link, 'doi\\.[a-z]+/(.+)', 1, 'i'), '') AS doi FROM pap WHERE doi IS NOT NULL".replace("\\\\", "\\")))
def _(r: Roles):
    return r.works.select("paper_id", text.doi(F.col("link")).alias("doi")).filter("doi IS NOT NULL")


@query("stripped_documents", "SELECT doc_id, length(regexp_replace(text, '</?[^>]+(>|$)', '', 'g')) AS n_chars, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS n_escaped FROM documents")
def _(r: Roles):
    return r.t("documents").select("doc_id", F.length(text.without_tags(F.col("text"))).cast("bigint").alias("n_chars"), F.length(text.escape_html(F.col("text"))).cast("bigint").alias("n_escaped"))


@query("document_tokens", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}-]+'), lambda t: length(t) >= 2)) AS n_tokens FROM documents")
def _(r: Roles):
    return r.t("documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("json_props", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY ALL")
def _(r: Roles):
    return r.t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum"), F.count(F.lit(1)).alias("n"))


# coordinates

_XYZ = "v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_BOX = "b AS (SELECT " + ", ".join(f"min({a}) - CASE WHEN max({a}) > min({a}) THEN max({a}) - min({a}) ELSE 1 END * 1e-4 AS lo_{a}, max({a}) + CASE WHEN max({a}) > min({a}) THEN max({a}) - min({a}) ELSE 1 END * 1e-4 AS hi_{a}" for a in "xyz") + " FROM v)"


def _vectors(r: Roles):
    v = r.t("embeddings").select(F.col("vec_id").alias("i"), "label", *[F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate("xyz")])
    return v


@query("bounding_box", sql(_XYZ, _BOX, body="SELECT " + ", ".join(f"round({n}_{a}, 6) AS {n}_{a}" for n in ("lo", "hi") for a in "xyz") + " FROM b"))
def _(r: Roles):
    return atlas.bounds(_vectors(r)).select(*[F.round(f"{n}_{a}", 6).alias(f"{n}_{a}") for n in ("lo", "hi") for a in "xyz"])


@query("quantised_points", sql(_XYZ, _BOX, body="SELECT vec_id AS i, " + ", ".join(f"greatest(0, least(65535, round_even(({a} - lo_{a}) / (hi_{a} - lo_{a}) * 65535, 0)::INTEGER)) AS q{a}" for a in "xyz") + " FROM v CROSS JOIN b"))
def _(r: Roles):
    return atlas.quantised_points(_vectors(r))


@query("label_centroids", sql(_XYZ, body="SELECT label, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z, count(*) AS n_points FROM v GROUP BY ALL"))
def _(r: Roles):
    return atlas.anchors(_vectors(r), ["label"])


def _placed(r: Roles):
    return atlas.layout(r.points.select("i", "paper_id", "theme", "domain", F.col("citation_count").alias("citations")))


@query("layout_positions")
def _(r: Roles):
    return _placed(r).select("i", "paper_id", "x", "y", "z")


#: Points a node of these queries holds: few enough that the test tables make several levels.
SHOWN_CAPACITY = 512


@query("octree_nodes")
def _(r: Roles):
    return atlas.node_headers(atlas.octree(_placed(r), SHOWN_CAPACITY))


@query("tile_payloads")
def _(r: Roles):
    from ..session import cut

    points = cut(_placed(r))
    box = atlas.bounds(points).first().asDict()
    made = atlas.tiles(atlas.octree(points, SHOWN_CAPACITY), box, atlas.dictionary(points, "theme"), atlas.dictionary(points, "domain"))
    return made.select("node_key", "n_points", F.length("payload").cast("bigint").alias("n_bytes"), atlas.tile_count().alias("n_said"), F.md5("payload").alias("digest"))


# engagement: events as actions on content (their value's whole part)

_EV = "ev AS (SELECT event_id, ts, event_type, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, 'ip' || (user_id % 40) AS ip, event_id % 200 AS content FROM events)"
_WHO = "coalesce('u:' || user_id, 'ip:' || ip)"


def _actions(r: Roles):
    return r.t("events").select(F.col("event_id").alias("comment_id"), F.col("ts").alias("at"), "event_type", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.concat(F.lit("ip"), (F.col("user_id") % 40).cast("string")).alias("ip"), (F.col("event_id") % 200).alias("content"))


@query("likes_once", sql(_EV, body=f"SELECT DISTINCT content, {_WHO} AS who FROM ev WHERE event_type = 'click'"))
def _(r: Roles):
    return engagement.likes(_actions(r).filter("event_type = 'click'"))


@query("likes_left", sql(_EV, body=f"SELECT DISTINCT content, {_WHO} AS who FROM ev WHERE event_type = 'click' EXCEPT SELECT content, {_WHO} FROM ev WHERE event_type = 'error'"))
def _(r: Roles):
    a = _actions(r)
    return engagement.unliked(engagement.likes(a.filter("event_type = 'click'")), a.filter("event_type = 'error'"))


@query("first_comments", sql(_EV, body=f"SELECT event_id AS comment_id, content, {_WHO} AS who FROM ev WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY content, {_WHO} ORDER BY ts, event_id) = 1"))
def _(r: Roles):
    return engagement.first_comments(_actions(r).filter("event_type = 'view'")).select("comment_id", "content", "who")


@query("content_counts", sql(_EV, body=f"SELECT content, coalesce(n_likes, 0) AS n_likes, coalesce(n_comments, 0) AS n_comments FROM (SELECT DISTINCT content FROM ev) LEFT JOIN (SELECT content, count(DISTINCT {_WHO}) AS n_likes FROM ev WHERE event_type = 'click' GROUP BY ALL) USING (content) LEFT JOIN (SELECT content, count(DISTINCT {_WHO}) AS n_comments FROM ev WHERE event_type = 'view' GROUP BY ALL) USING (content)"))
def _(r: Roles):
    a = _actions(r)
    return engagement.content_counts(a.select("content").distinct(), engagement.likes(a.filter("event_type = 'click'")), engagement.first_comments(a.filter("event_type = 'view'")))


@query("newest_content", "SELECT suggestion_id AS content, createdAt AS at FROM (SELECT DISTINCT * FROM suggestion) WHERE category = 'Bug Report' ORDER BY createdAt DESC, suggestion_id LIMIT 9 OFFSET 9")
def _(r: Roles):
    return engagement.newest(r.t("suggestion").distinct().filter("category = 'Bug Report'").select(F.col("suggestion_id").alias("content"), F.col("createdAt").alias("at")), 2, 9)
