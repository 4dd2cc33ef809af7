"""Queries and SQL of the composed reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import directory, graph, search, serve
from ..operators.identity import with_unit
from .atlas import _CELLS, _G, _HOLDS, _PHRASES, _POINT, _UNIT_POINT, _placed
from .directory import _CARD
from .roles import OWNED, PEOPLE, WORKS, Roles, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def _rank(column: str, q: str, weight: str, limit: int) -> str:
    tokens = " AND ".join(f"contains(lower({column}), '{t}')" for t in q.split())
    return f"WHERE contains(lower({column}), '{q}') OR ({tokens}) ORDER BY lower(trim({column})) = '{q}' DESC, starts_with(lower(trim({column})), '{q}') DESC, {weight} DESC, {column} LIMIT {limit}"


_UNIT_COUNT = "uc AS (SELECT unit_name, count(*) AS n_papers FROM up GROUP BY ALL)"


@query("unit_matches", sql(PEOPLE, WORKS, OWNED, _UNIT_POINT, _UNIT_COUNT, body=f"SELECT unit_name, n_papers FROM uc {_rank('unit_name', 'of co', 'n_papers', 12)}"))
def _(r: Roles):
    counts = r.unit_points.groupBy("unit_name").agg(F.count(F.lit(1)).alias("n_papers"))
    return serve.ranked_matches(counts, "unit_name", "of co", "n_papers", 12)


@query("faculty_matches", sql(PEOPLE, WORKS, OWNED, body=f"SELECT faculty_id, name, n_papers FROM (SELECT f.faculty_id, f.full_name || ' ' || f.faculty_id AS name, count(*) AS n_papers FROM own JOIN fac f USING (faculty_id) GROUP BY ALL) {_rank('name', 'ru pr', 'n_papers', 12)}"))
def _(r: Roles):
    counts = r.owned.groupBy("faculty_id").agg(F.count(F.lit(1)).alias("n_papers")).join(r.people.select("faculty_id", F.concat_ws(" ", "name", "faculty_id").alias("name")), "faculty_id")
    return serve.ranked_matches(counts, "name", "ru pr", "n_papers", 12).select("faculty_id", "name", "n_papers")


@query("base_set_by_unit", sql(PEOPLE, WORKS, OWNED, _UNIT_POINT, body="SELECT DISTINCT i FROM up WHERE lower(trim(unit_name)) = 'department of polymer dynamics'"))
def _(r: Roles):
    people_points = r.owned.join(r.people.select("faculty_id", "name"), "faculty_id").join(r.places, "paper_id").select("i", "name")
    return serve.base_set(r.points, r.unit_points, people_points, "Department of Polymer Dynamics ")


@query("base_set_by_text", sql(WORKS, _POINT, body=f"SELECT DISTINCT i FROM pt WHERE {_HOLDS('soil')} AND {_HOLDS('samp')}"))
def _(r: Roles):
    none = r.unit_points.limit(0)
    return serve.base_set(r.points, none, none.select("i", F.col("unit_name").alias("name")), "soil samp")


@query("theme_terms", sql(*_G, _CELLS, body="SELECT type, term, unit_name, CAST(sum(n_papers) AS BIGINT) AS n_papers, count(*) AS n_faculty, string_agg(faculty_id, ',' ORDER BY n_papers DESC, faculty_id) AS faculty_ids FROM cells WHERE type = 'theme' AND term = 'Food and Energy' GROUP BY ALL"))
def _(r: Roles):
    # the filter on the group's own columns reaches below the aggregation
    return graph.explore_detail(graph.term_cells(r.owned, r.labelled_works, r.homes)).filter("type = 'theme' AND term = 'Food and Energy'")


@query("people_for_query", sql(PEOPLE, WORKS, OWNED, _POINT, body=f"SELECT unit_name, faculty_id, full_name AS name, count(*) AS n_papers FROM (SELECT paper_id FROM pt WHERE {_HOLDS('membrane')} AND {_HOLDS('samp')}) JOIN own USING (paper_id) JOIN home USING (faculty_id) GROUP BY ALL"))
def _(r: Roles):
    return serve.people_for(search.search(r.points, "membrane samp", 70_000), r.owned, r.homes, r.people)


@query("cards_on_the_wire", sql(PEOPLE, body=f"SELECT * REPLACE (coalesce(h_index, 0) AS h_index, coalesce(citation_count, 0) AS citation_count) FROM (SELECT {_CARD} FROM home)"))
def _(r: Roles):
    return serve.wire(directory.cards(with_unit(r.people, r.departments)), ["h_index", "citation_count"])


@query("paper_catalogue_json", sql(WORKS, body="SELECT paper_id, to_json({'citations': coalesce(citation_count, 0), 'domain': domain, 'paper_id': paper_id, 'theme': theme, 'title': title, 'topic': topic})::VARCHAR AS payload FROM lab"))
def _(r: Roles):
    return serve.json_lines(r.labelled_works.select("paper_id", "title", "theme", "domain", "topic", F.coalesce("citation_count", F.lit(0)).alias("citations")), "paper_id")


@query("coordinates_of_unit")
def _(r: Roles):
    wanted = r.unit_points.filter("unit_name = 'Department of Polymer Dynamics'")
    return serve.coordinates(_placed(r).select("i", "paper_id", "theme", "domain", "x", "y", "z"), wanted)


_ASKED = "CAST(len(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}-]+'), lambda t: t = 'comp')) AS INTEGER)"
_OFFERS = f"""SELECT 'keyword' AS kind, term AS text, n FROM (SELECT * FROM (SELECT term, count(*) AS n FROM (SELECT a AS term FROM g UNION ALL SELECT a || ' ' || b FROM g WHERE gb UNION ALL SELECT a || ' ' || b || ' ' || c FROM g WHERE gb AND gc) GROUP BY ALL) ORDER BY n DESC, length(term), term LIMIT 8)
UNION ALL SELECT 'theme', theme, n FROM (SELECT theme, count(*) AS n FROM pt WHERE contains(lower(title), 'comp') AND theme <> '' GROUP BY ALL ORDER BY n DESC, theme LIMIT 8)
UNION ALL SELECT 'term', term, n_papers FROM (SELECT * FROM (SELECT type, term, CAST(sum(n_papers) AS BIGINT) AS n_papers FROM cells GROUP BY ALL) {_rank('term', 'comp', 'n_papers', 8)})
UNION ALL SELECT 'unit', unit_name, n FROM (SELECT * FROM (SELECT dept_id, unit_name, count(*) AS n FROM member GROUP BY ALL) {_rank('unit_name', 'comp', 'n', 8)})
UNION ALL SELECT 'person', name, n FROM (SELECT * FROM (SELECT full_name AS name, h_index AS n FROM fac) {_rank('name', 'comp', 'n', 8)})
UNION ALL SELECT 'paper', title, score FROM (SELECT paper_id, title, score FROM (SELECT paper_id, title, 10 * {_ASKED.format('title')} + {_ASKED.format('abstract')} AS score FROM pap) WHERE score > 0 ORDER BY score DESC, paper_id LIMIT 8)"""


@query("suggestions", sql(*_G, _CELLS, _POINT, _PHRASES.replace("'mem'", "'comp'"), body=_OFFERS))
def _(r: Roles):
    terms = graph.explore_terms(graph.term_cells(r.owned, r.labelled_works, r.homes))
    return serve.suggestions(r.points, terms, directory.unit_summary(r.people, r.departments), r.people, "comp", papers=r.works.select("paper_id", "title", "abstract"))


_TEXT = "SELECT i, paper_id, title, score FROM (SELECT * FROM (SELECT paper_id, title, 10 * {0} + {1} AS score FROM pap) WHERE score > 0 ORDER BY score DESC, paper_id LIMIT 500) JOIN place USING (paper_id)".format(*(_ASKED.format(c).replace("t = 'comp'", "t IN ('membrane', 'soil')") for c in ("title", "abstract")))


@query("paper_text_search", sql(WORKS, body=_TEXT))
def _(r: Roles):
    return search.paper_hits(r.works.select("paper_id", "title", "abstract"), r.places, "membrane soil")
