"""Queries and SQL of the catalogue: search contracts, clusters, reads by id, profile papers, and maintenance reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, directory, graph, maintain, search
from ..operators.catalog import Filters
from .atlas import _HOLDS, _POINT, _UNIT_POINT
from .directory import _LISTED, _listed
from .roles import OWNED, PEOPLE, WORKS, Roles, ref_sql, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def _catalog(r: Roles):
    return r.labelled_works.select("paper_id", "title", "theme", "domain", "subdomain", "topic", "document_type", F.col("publication_year").alias("year"), "citation_count", F.transform("authors", lambda a: a["author_id"]).alias("author_ids"))


_CAT = "cat AS (SELECT paper_id, title, theme, domain, subdomain, topic, document_type, publication_year AS year, citation_count, list_transform(authors, lambda a: a.author_id) AS author_ids FROM lab)"


def _score(words: list[str], fields=search.FIELDS) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return " + ".join(f"len(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}-]+'), lambda t: t IN ({listed}))) * {search.WEIGHTS[c]}" for c in fields)


_HIT = f"hit AS (SELECT *, CAST({_score(['membrane', 'soil'])} AS INTEGER) AS score FROM cat WHERE year >= 2005 AND document_type IN ('Article', 'Review') AND coalesce(citation_count, 0) >= 3)"
_FILTERS = Filters(years=(2005, None), kinds=("Article", "Review"), least_citations=3)


# the search contract


@query("catalog_search", sql(WORKS, _CAT, _HIT, body="SELECT paper_id, title, year, citation_count, score FROM hit WHERE score > 0 ORDER BY score DESC, paper_id LIMIT 20 OFFSET 20"))
def _(r: Roles):
    return catalog.found_page(catalog.hits(_catalog(r), "membrane soil", _FILTERS), "relevance", 2, 20).select("paper_id", "title", "year", "citation_count", "score")


@query("catalog_search_by_impact", sql(WORKS, _CAT, _HIT, body="SELECT paper_id, round(coalesce(citation_count, 0) / greatest(1, 2026 - coalesce(year, 2026) + 1), 6) AS per_year FROM hit WHERE score > 0 ORDER BY coalesce(citation_count, 0) / greatest(1, 2026 - coalesce(year, 2026) + 1) DESC, paper_id LIMIT 30"))
def _(r: Roles):
    return catalog.found_page(catalog.hits(_catalog(r), "membrane soil", _FILTERS), "normalized", 1, 30).select("paper_id", F.round("per_year", 6).alias("per_year"))


@query("catalog_search_by_date", sql(WORKS, _CAT, _HIT, body="SELECT paper_id, year FROM hit WHERE score > 0 ORDER BY year DESC NULLS LAST, paper_id LIMIT 30"))
def _(r: Roles):
    return catalog.found_page(catalog.hits(_catalog(r), "membrane soil", _FILTERS), "date", 1, 30).select("paper_id", "year")


@query("catalog_search_basic", sql(WORKS, _CAT, body="SELECT paper_id FROM cat WHERE list_contains(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}-]+'), 'membrane') AND list_contains(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}-]+'), 'arid')"))
def _(r: Roles):
    return catalog.hits(_catalog(r), "membrane arid", fields=("title",), basic=True).select("paper_id")


@query("catalog_refined", sql(WORKS, _CAT, body=f"SELECT paper_id FROM cat WHERE {_HOLDS('membrane')} AND {_HOLDS('energy')} AND {_HOLDS('plants')}"))
def _(r: Roles):
    return catalog.hits(_catalog(r), "", Filters(refinements=("membrane", "energy", "plants"))).select("paper_id")


@query("catalog_facets", sql(WORKS, _CAT, _HIT, body="SELECT facet, value, count(*) AS n FROM (SELECT unnest([{'facet': 'year', 'value': year::VARCHAR}, {'facet': 'kind', 'value': document_type}, {'facet': 'theme', 'value': theme}, {'facet': 'domain', 'value': domain}], recursive := true) FROM hit WHERE score > 0) WHERE value <> '' GROUP BY ALL"))
def _(r: Roles):
    return catalog.facet_counts(catalog.hits(_catalog(r), "membrane soil", _FILTERS))


_TOP_AUTHOR = "top AS (SELECT max(author_id) AS author_id FROM (SELECT unnest(authors).author_id AS author_id FROM pap) WHERE author_id <> '')"


def _last_author(r: Roles) -> str:
    return r.works.select(F.explode("authors").alias("a")).agg(F.max("a.author_id")).first()[0]


@query("search_within_author", sql(WORKS, _CAT, _TOP_AUTHOR, body="SELECT paper_id, year FROM cat WHERE list_contains(author_ids, (SELECT author_id FROM top)) ORDER BY year DESC NULLS LAST, paper_id LIMIT 20"))
def _(r: Roles):
    return catalog.found_page(catalog.hits(_catalog(r), "", Filters(author_id=_last_author(r))), "date", 1, 20).select("paper_id", "year")


@query("suggest_people_and_papers", sql(PEOPLE, WORKS, body="""SELECT * FROM (SELECT 'author' AS intent, faculty_id AS id, full_name AS text, CASE WHEN lower(trim(full_name)) = 'tra' THEN 100 WHEN starts_with(lower(trim(full_name)), 'tra') THEN 80 ELSE 50 END AS confidence FROM fac WHERE contains(lower(full_name), 'tra') ORDER BY 4 DESC, 3, 2 LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'paper', paper_id, title, CASE WHEN lower(trim(title)) = 'tra' THEN 100 WHEN starts_with(lower(trim(title)), 'tra') THEN 80 ELSE 50 END AS c FROM pap WHERE contains(lower(title), 'tra') ORDER BY 4 DESC, 3, 2 LIMIT 5)"""))
def _(r: Roles):
    return catalog.suggested(_catalog(r), r.people, "tra", 5)


@query("document_by_id", sql(WORKS, _CAT, body="SELECT paper_id, title, year FROM cat WHERE paper_id = (SELECT min(paper_id) FROM pap)"))
def _(r: Roles):
    first = r.works.agg(F.min("paper_id")).first()[0]
    return _catalog(r).filter(F.col("paper_id") == first).select("paper_id", "title", "year")


@query("publications_by_author_id", sql(WORKS, _TOP_AUTHOR, body="SELECT paper_id, title, publication_year, coalesce(citation_count, 0) AS citation_count FROM pap WHERE list_contains(list_transform(authors, lambda a: a.author_id), (SELECT author_id FROM top)) AND publication_year = (SELECT max(publication_year) FROM pap WHERE list_contains(list_transform(authors, lambda a: a.author_id), (SELECT author_id FROM top))) ORDER BY citation_count DESC, paper_id LIMIT 20"))
def _(r: Roles):
    from ..operators import research

    author = _last_author(r)
    year = r.works.filter(F.exists("authors", lambda a: a["author_id"] == author)).agg(F.max("publication_year")).first()[0]
    return research.publications(r.works, None, [author], year)


@query("combination_counts", sql(PEOPLE, WORKS, OWNED, _CAT, body="SELECT count(DISTINCT paper_id) AS n_papers, count(DISTINCT faculty_id) AS n_faculty FROM cat LEFT JOIN own USING (paper_id) WHERE theme = 'Food and Energy' AND year >= 2000 AND year <= 2015"))
def _(r: Roles):
    return catalog.combination_counts(_catalog(r), r.owned, Filters(themes=("Food and Energy",), years=(2000, 2015)))


@query("ranked_people", sql(PEOPLE, WORKS, OWNED, _CAT, body="SELECT faculty_id, count(*) AS n_papers FROM cat JOIN own USING (paper_id) WHERE theme = 'Food and Energy' GROUP BY ALL ORDER BY n_papers DESC, faculty_id LIMIT 20"))
def _(r: Roles):
    return catalog.ranked_people(_catalog(r), r.owned, Filters(themes=("Food and Energy",)))


@query("papers_of_person", sql(PEOPLE, WORKS, OWNED, _CAT, body="SELECT paper_id, title, year FROM cat WHERE paper_id IN (SELECT paper_id FROM own WHERE faculty_id = (SELECT max(faculty_id) FROM fac)) ORDER BY year DESC NULLS LAST, paper_id LIMIT 20"))
def _(r: Roles):
    person = r.people.agg(F.max("faculty_id")).first()[0]
    return catalog.papers_of(_catalog(r), r.owned, person).select("paper_id", "title", "year")


@query("profile_catalog_search", "SELECT row_key, title FROM scholar_papers WHERE contains(lower(title), 'membrane') OR contains(lower(title), 'reef') ORDER BY row_key LIMIT 25")
def _(r: Roles):
    rows = r.t("scholar_papers")
    return rows.filter(catalog.holds(F.col("title"), "membrane") | catalog.holds(F.col("title"), "reef")).orderBy("row_key").limit(25).select("row_key", "title")


@query("reranked_vectors", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))), 5) AS relevance FROM embeddings ORDER BY relevance DESC, vec_id LIMIT 20")
def _(r: Roles):
    v = r.t("embeddings").select("vec_id", "embedding")
    asked = v.orderBy("vec_id").first()["embedding"]
    return catalog.reranked(v, asked, 20)


# clusters


@query("cluster_units", sql(PEOPLE, WORKS, OWNED, _POINT, _UNIT_POINT, body=f"SELECT coalesce(unit_name, 'Unassigned') AS unit_name, count(*) AS n_papers, array_to_string(list_slice(list(i ORDER BY i), 1, 5), ',') AS first_papers FROM (SELECT i FROM pt WHERE theme = 'Food and Energy' AND {_HOLDS('layers')}) LEFT JOIN up USING (i) GROUP BY ALL"))
def _(r: Roles):
    return catalog.cluster_units(r.points, r.unit_points, "Food and Energy", "layers", 5)


def _people_points(r: Roles):
    return r.owned.join(r.homes, "faculty_id").join(r.people.select("faculty_id", "name"), "faculty_id").join(r.places, "paper_id").select("i", "unit_name", "faculty_id", "name")


@query("cluster_people", sql(PEOPLE, WORKS, OWNED, _POINT, body=f"SELECT lower(trim(unit_name)) AS unit, faculty_id, full_name AS name, count(*) AS n_papers, array_to_string(list_slice(list(i ORDER BY i), 1, 20), ',') AS first_papers FROM (SELECT i, paper_id FROM pt WHERE theme = 'Food and Energy' AND {_HOLDS('layers')}) JOIN own USING (paper_id) JOIN home USING (faculty_id) GROUP BY ALL"))
def _(r: Roles):
    return catalog.cluster_people(r.points, _people_points(r), "Food and Energy", "layers")


@query("cluster_papers", sql(PEOPLE, WORKS, OWNED, _POINT, _UNIT_POINT, body=f"SELECT unit_name, rank, i, paper_id, title, domain, topic, citations FROM (SELECT coalesce(unit_name, 'Unassigned') AS unit_name, row_number() OVER (PARTITION BY coalesce(unit_name, 'Unassigned') ORDER BY i) AS rank, i, paper_id, coalesce(title, '') AS title, domain, topic, coalesce(citation_count, 0) AS citations FROM (SELECT * FROM pt WHERE theme = 'Food and Energy' AND {_HOLDS('layers')}) LEFT JOIN up USING (i)) WHERE rank <= 3"))
def _(r: Roles):
    return catalog.cluster_papers(r.points, r.unit_points, "Food and Energy", "layers")


# index sets and matches


@query("search_within_set", sql(PEOPLE, WORKS, OWNED, _POINT, _UNIT_POINT, body=f"SELECT i FROM pt WHERE {_HOLDS('arid')} AND i IN (SELECT i FROM up WHERE unit_name = 'Department of Polymer Dynamics')"))
def _(r: Roles):
    hits = r.points.filter(search.all_tokens_in_any("arid", [F.col(c) for c in search.FIELDS]))
    return catalog.within(hits, r.unit_points.filter("unit_name = 'Department of Polymer Dynamics'")).select("i")


@query("units_within_set", sql(PEOPLE, WORKS, OWNED, _POINT, _UNIT_POINT, body="SELECT DISTINCT unit_name, i FROM up WHERE contains(lower(unit_name), 'comp') AND i IN (SELECT i FROM pt WHERE theme = 'Food and Energy')"))
def _(r: Roles):
    return catalog.within(r.unit_points.filter(catalog.holds(F.col("unit_name"), "comp")), r.points.filter("theme = 'Food and Energy'")).select("unit_name", "i").distinct()


@query("positions_of_unit_matches", sql(PEOPLE, WORKS, OWNED, _UNIT_POINT, body="SELECT DISTINCT i FROM up WHERE lower(trim(unit_name)) = 'department of polymer dynamics'"))
def _(r: Roles):
    matches = r.unit_points.select("unit_name").distinct().filter(catalog.holds(F.col("unit_name"), "department of polymer dynamics"))
    return catalog.positions_of_matches(matches, r.unit_points, "unit_name", "Department of Polymer Dynamics")


@query("positions_of_people_matches", sql(PEOPLE, WORKS, OWNED, body="SELECT DISTINCT i FROM own JOIN fac USING (faculty_id) JOIN place USING (paper_id) WHERE contains(lower(full_name), 'tra')"))
def _(r: Roles):
    matches = r.people.select("name").distinct().filter(catalog.holds(F.col("name"), "tra"))
    return catalog.positions_of_matches(matches, r.owned.join(r.people.select("faculty_id", "name"), "faculty_id").join(r.places, "paper_id"), "name", "tra")


@query("bounded_prefetch", sql(WORKS, _POINT, body="SELECT i, citation_count FROM (SELECT i, citation_count FROM pt ORDER BY i LIMIT 200) ORDER BY citation_count DESC NULLS LAST, i LIMIT 20"))
def _(r: Roles):
    return catalog.prefetched(r.points.select("i", "citation_count"), "i", 200, "citation_count", 20)


@query("papers_since", sql(WORKS, _POINT, body="SELECT i FROM pt WHERE year >= 2020"))
def _(r: Roles):
    return catalog.since(r.points, 2020, 2026)


@query("related_topics", sql(WORKS, _POINT, body="SELECT topic, count(*) AS n_papers FROM (SELECT i, topic FROM pt WHERE contains(lower(title), 'alloy') ORDER BY i LIMIT 800) WHERE topic <> '' GROUP BY ALL ORDER BY n_papers DESC, topic LIMIT 8"))
def _(r: Roles):
    first = r.points.filter(catalog.holds(F.col("title"), "alloy")).orderBy("i").limit(800)
    return first.filter("topic <> ''").groupBy("topic").agg(F.count(F.lit(1)).alias("n_papers")).orderBy(F.desc("n_papers"), "topic").limit(8)


# people


@query("best_people_by_text", sql(PEOPLE, body="SELECT * FROM (" + "SELECT faculty_id, full_name AS name, CAST(" + " + ".join(f"len(list_filter(regexp_split_to_array(lower(coalesce({c if c in ('firstName', 'lastName') else f'''array_to_string({c}, ' ')'''}, '')), '[^\\p{{L}}\\p{{N}}-]+'), lambda t: t IN ('membrane', 'analysis', 'robust'))) * {w}" for c, w in directory.FIELD_WEIGHTS.items()) + " AS INTEGER) AS score FROM fac) WHERE score > 0 ORDER BY score DESC, faculty_id LIMIT 10"))
def _(r: Roles):
    return directory.best_text(r.people, "membrane analysis robust")


@query("resolve_mailboxes", sql(PEOPLE, WORKS, body="SELECT asked, faculty_id, full_name AS name FROM (SELECT DISTINCT lower(trim(kerberos)) AS asked FROM pap WHERE trim(kerberos) <> '' ORDER BY asked LIMIT 100) JOIN fac ON starts_with(lower(email), asked || '@')"))
def _(r: Roles):
    return catalog.resolve_mailboxes(r.works.select("kerberos"), r.people)


_TWO_STEPS = f"""step AS (SELECT faculty_id, a.dept_id AS by_id, b.dept_id AS by_code FROM (SELECT DISTINCT faculty_id, {ref_sql('department')} AS ref FROM faculty) f LEFT JOIN (SELECT DISTINCT lower(dept_id) AS ref, dept_id FROM departments) a USING (ref) LEFT JOIN (SELECT DISTINCT upper(code) AS ref, dept_id FROM departments) b USING (ref))"""


@query("unit_of_reference", sql(_TWO_STEPS, body="SELECT faculty_id, coalesce(by_code, by_id) AS dept_id, CASE WHEN by_code IS NOT NULL THEN 'code' WHEN by_id IS NOT NULL THEN 'id' ELSE 'none' END AS found_by FROM step"))
def _(r: Roles):
    from ..operators.identity import reference_key

    refs = r.t("faculty").select("faculty_id", reference_key(F.col("department")).alias("ref")).distinct()
    units = r.departments.select("dept_id", "code").distinct()
    both = refs.join(units.select(F.upper("code").alias("ref"), F.col("dept_id").alias("by_code")), "ref", "left").join(units.select(F.lower("dept_id").alias("ref"), F.col("dept_id").alias("by_id")), "ref", "left")
    found = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_id").isNotNull(), "id").otherwise("none")
    return both.select("faculty_id", F.coalesce("by_code", "by_id").alias("dept_id"), found.alias("found_by"))


@query("service_counts", sql(WORKS, body="SELECT 'papers' AS part, count(*) AS n FROM pap UNION ALL SELECT 'faculty', count(*) FROM (SELECT DISTINCT * FROM faculty) UNION ALL SELECT 'units', count(*) FROM (SELECT DISTINCT dept_id FROM departments) UNION ALL SELECT 'themes', count(*) FROM (SELECT DISTINCT id FROM themes)"))
def _(r: Roles):
    return catalog.table_counts({"papers": r.works, "faculty": r.people, "units": r.departments.select("dept_id").distinct(), "themes": r.t("themes").select("id").distinct()})


@query("faculty_index", sql(PEOPLE, WORKS, OWNED, body="SELECT f.faculty_id, f.full_name AS name, h.unit_name, count(o.paper_id) AS n_papers FROM fac f LEFT JOIN (SELECT faculty_id, unit_name FROM home) h USING (faculty_id) LEFT JOIN own o USING (faculty_id) GROUP BY ALL"))
def _(r: Roles):
    counts = r.owned.groupBy("faculty_id").agg(F.count(F.lit(1)).alias("n_papers"))
    return r.people.select("faculty_id", "name").join(r.homes, "faculty_id", "left").join(counts, "faculty_id", "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0)))


@query("timeline_years_page", sql(WORKS, body="SELECT kerberos, publication_year, n_papers, place FROM (SELECT *, row_number() OVER (PARTITION BY kerberos ORDER BY publication_year DESC) - 1 AS place FROM (SELECT kerberos, publication_year, count(*) AS n_papers FROM pap WHERE trim(kerberos) <> '' AND publication_year IS NOT NULL GROUP BY ALL)) WHERE place >= 3 AND place < 7"))
def _(r: Roles):
    return catalog.timeline_years(r.works, 3, 4)


_PROF = """prof AS (SELECT f.faculty_id, 'stored' AS source, p.title, p.publication_year AS year, coalesce(p.citation_count, 0) AS citations FROM fac f JOIN pap p ON lower(p.kerberos) = f.kerberos WHERE p.document_eid LIKE 'scholar\\_%' ESCAPE '\\' AND trim(p.kerberos) <> '' AND f.kerberos <> ''),
profs AS (SELECT * FROM prof UNION ALL SELECT f.faculty_id, 'fetched', s.title, s.year, coalesce(s.citations, 0) FROM fac f JOIN scholar_papers s ON s.scholar_id = list_filter(f.google_scholar_id, lambda x: trim(x) <> '')[1] WHERE f.faculty_id NOT IN (SELECT faculty_id FROM prof))""".replace("\\\\", "\\")


@query("profile_papers", sql(PEOPLE, WORKS, _PROF, body="SELECT faculty_id, source, title, year, citations FROM profs"))
def _(r: Roles):
    return catalog.profile_papers(r.people, r.works, r.t("scholar_papers").select("scholar_id", "title", "year", "citations"))


@query("research_summary", sql(PEOPLE, WORKS, OWNED, _PROF, body="""SELECT faculty_id, CASE WHEN has THEN 'papers' WHEN b IS NOT NULL THEN 'profile' ELSE 'none' END AS source, coalesce(CASE WHEN has THEN a ELSE b END, 0) AS n_papers, CAST(coalesce(CASE WHEN has THEN ac ELSE bc END, 0) AS BIGINT) AS n_citations
  FROM (SELECT faculty_id, len(list_filter(coalesce(scopus_id, []), lambda x: trim(x) <> '')) > 0 AS has FROM fac) LEFT JOIN (SELECT faculty_id, count(*) AS a, sum(coalesce(citation_count, 0)) AS ac FROM own JOIN pap USING (paper_id) GROUP BY ALL) USING (faculty_id) LEFT JOIN (SELECT faculty_id, count(*) AS b, sum(citations) AS bc FROM profs GROUP BY ALL) USING (faculty_id)"""))
def _(r: Roles):
    profile = catalog.profile_papers(r.people, r.works, r.t("scholar_papers").select("scholar_id", "title", "year", "citations"))
    return catalog.research_summary(r.people, r.owned, r.works, profile)


@query("profile_timeline", "WITH s AS (SELECT *, coalesce(citations, 0) AS c FROM scholar_papers WHERE coalesce(year, 0) <> 0) SELECT venue, year, count(*) AS n_papers, CAST(sum(c) AS BIGINT) AS n_citations, array_to_string(list_slice(list(coalesce(title, '') ORDER BY c DESC, title NULLS FIRST, row_key), 1, 3), '|') AS top_titles FROM s GROUP BY ALL")
def _(r: Roles):
    return catalog.profile_timeline(r.t("scholar_papers"), "venue")


@query("newest_profile_papers", "SELECT venue, row_key, rank FROM (SELECT venue, row_key, row_number() OVER (PARTITION BY venue ORDER BY year DESC NULLS LAST, row_key) AS rank FROM scholar_papers) WHERE rank <= 4")
def _(r: Roles):
    return catalog.newest_papers(r.t("scholar_papers"), "venue", 4).select("venue", "row_key", "rank")


# text and keys over whole tables


@query("plain_titles", "SELECT row_key, trim(regexp_replace(regexp_replace(lower(coalesce(Title, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM build_kg".replace("\\\\", "\\"))
def _(r: Roles):
    return r.t("build_kg").select("row_key", catalog.plain_title(F.col("Title")).alias("plain"))


@query("clean_references", sql(WORKS, body="SELECT DISTINCT paper_id, regexp_replace(u.faculty_ref, '[^A-Za-z0-9_-]', '', 'g') AS ref FROM (SELECT paper_id, unnest(iitd_authors) AS u FROM pap) WHERE u.faculty_ref IS NOT NULL"))
def _(r: Roles):
    return r.works.select("paper_id", F.explode("iitd_authors").alias("u")).filter("u.faculty_ref IS NOT NULL").select("paper_id", catalog.clean_id(F.col("u.faculty_ref")).alias("ref")).distinct()


@query("author_set_keys", sql(WORKS, body="SELECT paper_id, substr(sha256(array_to_string(list_sort(list_transform(authors, lambda a: a.author_id)), ',')), 1, 16) AS key FROM pap WHERE authors IS NOT NULL AND len(list_filter(authors, lambda a: a.author_id IS NULL)) = 0"))
def _(r: Roles):
    ids = F.transform("authors", lambda a: a["author_id"])
    return r.works.filter(F.col("authors").isNotNull() & ~F.exists(ids, lambda x: x.isNull())).select("paper_id", catalog.digest_key(ids).alias("key"))


@query("clipped_names", sql(PEOPLE, body="SELECT faculty_id, rpad(substr(coalesce(full_name, ''), 1, 12), 12, ' ') AS shown FROM fac"))
def _(r: Roles):
    return r.people.select("faculty_id", catalog.clipped(F.col("name"), 12).alias("shown"))


@query("named_authors_first", sql(WORKS, body="SELECT paper_id, array_to_string(list_transform(list_concat(list_filter(authors, lambda a: coalesce(trim(a.author_name) <> '', false)), list_filter(authors, lambda a: NOT coalesce(trim(a.author_name) <> '', false))), lambda a: coalesce(a.author_id, '-')), ',') AS author_ids FROM pap WHERE authors IS NOT NULL"))
def _(r: Roles):
    ordered = catalog.named_first(F.col("authors"), "author_name")
    return r.works.filter("authors IS NOT NULL").select("paper_id", F.array_join(F.transform(ordered, lambda a: F.coalesce(a["author_id"], F.lit("-"))), ",").alias("author_ids"))


@query("tolerant_numbers", "SELECT suggestion_id, CASE WHEN regexp_matches(replace(trim(split_part(message, ' ', 2)), ',', ''), '^[+-]?[0-9]{1,9}$') THEN replace(trim(split_part(message, ' ', 2)), ',', '')::INTEGER ELSE -1 END AS number FROM (SELECT DISTINCT suggestion_id, message FROM suggestion)")
def _(r: Roles):
    from ..functions.numbers import tolerant_int

    word = F.coalesce(F.get(F.split("message", " "), F.lit(1)), F.lit(""))
    return r.t("suggestion").select("suggestion_id", "message").distinct().select("suggestion_id", tolerant_int(word, -1).alias("number"))


@query("content_by_status_and_owner", "SELECT suggestion_id FROM (SELECT DISTINCT * FROM suggestion) WHERE category = 'Feature Request' AND lower(trim(email)) LIKE '%.example%'")
def _(r: Roles):
    return r.t("suggestion").distinct().filter((F.col("category") == "Feature Request") & F.contains(F.lower(F.trim("email")), F.lit(".example"))).select("suggestion_id")


# maintenance


@query("stats_only_upsert", sql(PEOPLE, body="SELECT coalesce(o.email, n.email) AS email, coalesce(n.h_index, o.h_index) AS h_index, coalesce(n.citation_count, o.citation_count) AS citation_count, CASE WHEN o.email IS NULL THEN 'insert' WHEN n.email IS NOT NULL AND (coalesce(n.h_index, o.h_index) IS DISTINCT FROM o.h_index OR coalesce(n.citation_count, o.citation_count) IS DISTINCT FROM o.citation_count) THEN 'update' ELSE 'none' END AS action FROM (SELECT * FROM fac QUALIFY row_number() OVER (PARTITION BY email ORDER BY faculty_id) = 1) o FULL JOIN (SELECT * FROM faculty_upsert QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_key) = 1) n ON o.email = n.email"))
def _(r: Roles):
    first = lambda df, order: graph.first_rows(df.filter("email IS NOT NULL"), "email", order).unionByName(df.filter("email IS NULL").orderBy(order).limit(1))
    return maintain.upsert(first(r.people, "faculty_id"), first(r.t("faculty_upsert"), "row_key"), "email", ["h_index", "citation_count"])


@query("fields_by_mailbox", sql(PEOPLE, body="SELECT faculty_id, coalesce(n.h, f.h_index) AS h_index, coalesce(n.c, f.citation_count) AS citation_count, coalesce(n.h, f.h_index) IS DISTINCT FROM f.h_index OR coalesce(n.c, f.citation_count) IS DISTINCT FROM f.citation_count AS changed FROM fac f LEFT JOIN (SELECT lower(trim(split_part(email, '@', 1))) AS box, max(h_index) AS h, max(citation_count) AS c FROM faculty_upsert WHERE trim(split_part(email, '@', 1)) <> '' GROUP BY ALL) n ON starts_with(lower(f.email), n.box || '@')"))
def _(r: Roles):
    changes = r.t("faculty_upsert").select(F.substring_index("email", "@", 1).alias("kerberos"), "h_index", "citation_count")
    return maintain.set_by_mailbox(r.people, changes, ["h_index", "citation_count"])


_FIXES = {"pld": "Centre", "URM": "Other", "zzz": "Other"}


@query("category_corrections", "WITH c AS (SELECT * FROM (VALUES ('pld', 'Centre'), ('URM', 'Other'), ('zzz', 'Other')) t(k, wanted)) SELECT d.dept_id, coalesce(d.code, c.k) AS code, d.category AS previous, coalesce(c.wanted, d.category) AS category FROM (SELECT DISTINCT dept_id, code, category FROM departments) d FULL JOIN c ON lower(d.code) = lower(c.k)")
def _(r: Roles):
    return maintain.recategorised(r.departments, _FIXES)


_WANTED_UNITS = "w AS (SELECT upper(trim(department_code)) AS code, max(department_name) AS name, 'Department' AS category, upper(trim(department_code)) < 'N' AS may_create FROM faculty_upsert WHERE trim(department_code) <> '' GROUP BY upper(trim(department_code)))"


@query("unit_sync_plan", sql(_WANTED_UNITS, body="SELECT w.code, CASE WHEN d.code IS NULL THEN CASE WHEN may_create THEN 'create' ELSE 'skip' END WHEN w.name IS NOT DISTINCT FROM d.name AND w.category IS NOT DISTINCT FROM d.category THEN 'none' ELSE 'update' END AS action, w.name, w.category FROM w LEFT JOIN (SELECT upper(code) AS code, max(name) AS name, max(category) AS category FROM departments GROUP BY ALL) d USING (code)".replace("FROM departments GROUP BY ALL", "FROM departments GROUP BY upper(code)")))
def _(r: Roles):
    wanted = r.t("faculty_upsert").select(F.upper(F.trim("department_code")).alias("code"), "department_name").filter("code <> ''").groupBy("code").agg(F.max("department_name").alias("name"))
    return maintain.unit_sync(wanted.withColumn("category", F.lit("Department")).withColumn("may_create", F.col("code") < "N"), r.departments)


@query("verified_matches", sql(PEOPLE, "m AS (SELECT row_key, faculty_id, u.email, upper(trim(u.department_code)) AS code FROM faculty_upsert u JOIN (SELECT lower(lastName) AS e, min(faculty_id) AS faculty_id FROM fac WHERE lastName <> '' GROUP BY lower(lastName)) f ON lower(u.lastName) = f.e)", body="""SELECT row_key, faculty_id, same_email, home_unit, affiliated, home_unit OR affiliated AS covered FROM (SELECT m.row_key, m.faculty_id, coalesce(lower(trim(m.email)) = lower(f.email), false) AS same_email, coalesce(h.dept_id = n.dept_id, false) AS home_unit,
  coalesce(list_contains(list_transform(coalesce(f.affiliations, []), lambda a: lower(regexp_replace(a, '[^A-Za-z0-9]', '', 'g'))), lower(n.dept_id)) OR list_contains(list_transform(coalesce(f.affiliations, []), lambda a: upper(regexp_replace(a, '[^A-Za-z0-9]', '', 'g'))), m.code), false) AS affiliated
  FROM m JOIN fac f USING (faculty_id) LEFT JOIN names n ON n.ref = m.code LEFT JOIN names h ON h.ref = f.unit_ref)"""))
def _(r: Roles):
    known = r.people.filter("lastName <> ''").groupBy(F.lower("lastName").alias("e")).agg(F.min("faculty_id").alias("faculty_id"))
    matches = r.t("faculty_upsert").withColumn("e", F.lower("lastName")).join(known, "e").select("row_key", "faculty_id", "email", F.col("department_code").alias("code"))
    return maintain.verified_matches(matches, r.people, r.departments)


@query("on_roster", sql(PEOPLE, _LISTED, body="SELECT h.faculty_id, h.dept_id FROM home h WHERE lower(h.dept_id) NOT IN (SELECT lower(dept_id) FROM listed) OR EXISTS (SELECT 1 FROM listed l WHERE lower(l.dept_id) = lower(h.dept_id) AND lower(l.faculty_id) = lower(h.faculty_id))"))
def _(r: Roles):
    from ..operators.identity import with_unit

    return maintain.on_roster(with_unit(r.people, r.departments).select("faculty_id", "dept_id"), _listed(r))


@query("too_few_papers", sql(WORKS, body="SELECT author_id FROM (SELECT DISTINCT unnest(authors).author_id AS author_id FROM pap) WHERE author_id <> '' EXCEPT SELECT author_id FROM (SELECT unnest(authors).author_id AS author_id FROM pap) GROUP BY author_id HAVING count(*) >= 5"))
def _(r: Roles):
    ids = r.works.select(F.explode("authors").alias("a")).select(F.col("a.author_id").alias("author_id")).filter("author_id <> ''")
    return ids.distinct().exceptAll(ids.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select("author_id"))


@query("maintenance_report", sql(PEOPLE, body="SELECT section, count(*) AS n FROM (SELECT 'units' AS section FROM (SELECT DISTINCT upper(trim(department_code)) AS code FROM faculty_upsert WHERE trim(department_code) <> '' AND upper(trim(department_code)) NOT IN (SELECT upper(code) FROM departments)) UNION ALL SELECT 'no unit' FROM fac WHERE unit_ref NOT IN (SELECT ref FROM names) OR unit_ref IS NULL) GROUP BY ALL"))
def _(r: Roles):
    from ..operators.identity import unit_names

    units = maintain.new_units(r.t("faculty_upsert").select(F.col("department_code").alias("code")), r.departments)
    lost = r.people.select("faculty_id", "unit_ref").join(unit_names(r.departments).select(F.col("ref").alias("unit_ref")), "unit_ref", "left_anti")
    return maintain.report({"units": units.withColumn("key", F.col("code")), "no unit": lost.withColumn("key", F.col("faculty_id"))}, "key").groupBy("section").agg(F.count(F.lit(1)).alias("n"))
