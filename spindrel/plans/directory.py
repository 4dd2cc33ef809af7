"""Queries and SQL over people and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import title_fits
from ..operators import directory, maintain, research, search
from .roles import PEOPLE, WORKS, Roles, sql

DOMAIN = "aravi-inst.example"
QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if text:
            SQL[name] = text
        return f

    return keep


_SHOWN = "CASE WHEN coalesce(metric_visibility.h_index, true) THEN coalesce(h_index, 0) END AS h_index, CASE WHEN coalesce(metric_visibility.citations, true) THEN coalesce(citation_count, 0) END AS citation_count"
_FIRST = "list_filter({0}, lambda x: length(trim(x)) > 0)[1] AS {0}"
_TAGS = "'all' || CASE category WHEN 'Department' THEN ',departments' WHEN 'School' THEN ',schools' WHEN 'Centre' THEN ',centres' WHEN 'Research Lab / Facility' THEN ',researchlabs' ELSE '' END"


@query("grouped_directory", sql(PEOPLE, body="SELECT dept_id, unit_name, count(*) AS n_faculty, round_even(avg(h_index), 1) AS mean_h_index, string_agg(faculty_id, ',' ORDER BY coalesce(h_index, -1) DESC, faculty_id) AS faculty_ids FROM member GROUP BY ALL"))
def _(r: Roles):
    return directory.grouped(r.people, r.departments)


@query("grouped_directory_centres", sql(PEOPLE, body="SELECT dept_id, unit_name, count(*) AS n_faculty, round_even(avg(h_index), 1) AS mean_h_index, string_agg(faculty_id, ',' ORDER BY coalesce(h_index, -1) DESC, faculty_id) AS faculty_ids FROM member WHERE category = 'Centre' GROUP BY ALL"))
def _(r: Roles):
    return directory.grouped(r.people, r.departments, "centres")


@query("grouped_directory_cards", sql(PEOPLE, body=f"SELECT dept_id, row_number() OVER (PARTITION BY dept_id ORDER BY coalesce(m.h_index, -1) DESC, faculty_id) AS place, faculty_id, full_name AS name, designation, {_SHOWN.replace('coalesce(h_index', 'coalesce(m.h_index').replace('coalesce(citation_count', 'coalesce(m.citation_count')} FROM member m"))
def _(r: Roles):
    return directory.grouped_cards(r.people, r.departments)


@query("directory_totals", sql(PEOPLE, body="SELECT count(DISTINCT dept_id) AS n_units, count(*) AS n_memberships, count(DISTINCT faculty_id) AS n_faculty FROM member"))
def _(r: Roles):
    return directory.totals(r.people, r.departments)


@query("units_in_order", "SELECT row_number() OVER (ORDER BY lower(name), name DESC) AS place, name FROM (SELECT DISTINCT name FROM departments) ORDER BY lower(name), name DESC LIMIT 40")
def _(r: Roles):
    return directory.units_in_order(r.departments, 40)


@query("unit_summary", sql(PEOPLE, body=f"SELECT dept_id, unit_name, count(*) AS n_faculty, {_TAGS} AS tags FROM member GROUP BY ALL"))
def _(r: Roles):
    return directory.unit_summary(r.people, r.departments)


@query("unit_members", sql(PEOPLE, body="SELECT faculty_id, full_name AS name, h_index FROM member WHERE code = 'PLD'"))
def _(r: Roles):
    return directory.unit_members(r.people, r.departments, "PLD")


_CARD = f"faculty_id, full_name AS name, title, designation, kerberos, unit_name, {_SHOWN}, profile_image_url"
_PAGE = "SELECT " + _CARD + " FROM home WHERE faculty_id IN (SELECT faculty_id FROM fac ORDER BY {0}, faculty_id LIMIT 9 OFFSET 9)"


@query("list_faculty_page", sql(PEOPLE, body=_PAGE.format("h_index DESC NULLS LAST")))
def _(r: Roles):
    return directory.page(r.people, r.departments, 2, 9)


@query("list_faculty_by_name", sql(PEOPLE, body=_PAGE.format("firstName ASC NULLS FIRST, lastName ASC NULLS FIRST")))
def _(r: Roles):
    return directory.page(r.people, r.departments, 2, 9, "name", "asc")


@query("faculty_cards", sql(PEOPLE, body=f"SELECT {_CARD} FROM home"))
def _(r: Roles):
    from ..operators.identity import with_unit

    return directory.cards(with_unit(r.people, r.departments))


_AREAS = """area AS (SELECT faculty_id, list_slice(list(v ORDER BY k), 1, 8) AS areas FROM (
  SELECT faculty_id, lower(v) AS low, arg_min(v, k) AS v, min(k) AS k FROM (
    SELECT faculty_id, trim(v) AS v, row_number() OVER (PARTITION BY faculty_id ORDER BY b, j) AS k FROM (
      {0}) WHERE trim(v) <> '') GROUP BY ALL) GROUP BY ALL)"""
_BUCKETS = "SELECT faculty_id, 1 AS b, unnest(list_transform(dominant_domains, lambda d: d.name)) AS v, generate_subscripts(dominant_domains, 1) AS j FROM fac" + "".join(f" UNION ALL SELECT faculty_id, {i}, unnest({c}), generate_subscripts({c}, 1) FROM fac" for i, c in ((2, "expertise"), (3, "brief_expertise"), (4, "subjects"), (5, "wos_subjects")))


@query(
    "faculty_details",
    sql(PEOPLE, _AREAS.format(_BUCKETS), body=f"""SELECT faculty_id, full_name AS name, kerberos, {_SHOWN}, coalesce(array_to_string(areas, '|'), '') AS research_areas, {', '.join(_FIRST.format(c) for c in ('scopus_id', 'google_scholar_id', 'orcid_id'))},
    d.name AS unit_name, {_TAGS} AS tags FROM fac LEFT JOIN area USING (faculty_id) LEFT JOIN names n ON n.ref = unit_ref LEFT JOIN dep d USING (dept_id)"""),
)
def _(r: Roles):
    return directory.details(r.people, r.departments)


@query("profile_extras", sql(PEOPLE, body="SELECT faculty_id, CASE WHEN background_visible THEN coalesce(background, '') ELSE '' END AS background, CASE WHEN qualifications_visible THEN coalesce(array_to_string(qualifications, '|'), '') ELSE '' END AS qualifications FROM fac"))
def _(r: Roles):
    return directory.profile_extras(r.people)


@query("main_domains", sql(PEOPLE, body="SELECT faculty_id, CAST(k - 1 AS INTEGER) AS pos, d.name AS domain, d.slug AS slug, coalesce(d.paper_count, 0) AS paper_count FROM (SELECT faculty_id, unnest(dominant_domains) AS d, generate_subscripts(dominant_domains, 1) AS k FROM fac) WHERE d.name <> '' AND d.slug <> ''"))
def _(r: Roles):
    return directory.main_domains(r.people)


@query("faculty_search_tokens", sql(PEOPLE, body=r"SELECT faculty_id, full_name AS name, CAST(CASE WHEN lower(full_name) = 'ru pr' THEN 3 ELSE 0 END + CASE WHEN regexp_matches(full_name, '\bru\b', 'i') THEN 2 ELSE 1 END + CASE WHEN regexp_matches(full_name, '\bpr\b', 'i') THEN 2 ELSE 1 END AS INTEGER) AS score, FROM fac WHERE contains(lower(full_name), 'ru') AND contains(lower(full_name), 'pr') ORDER BY score DESC, h_index DESC NULLS LAST, faculty_id LIMIT 20"))
def _(r: Roles):
    return directory.search_people(r.people, "ru pr", 20)


_COUNT = "len(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}-]+'), lambda t: t IN ('computing', 'sampling'))) * {1}"
_SCORE = " + ".join(_COUNT.format(c if c in ("firstName", "lastName") else f"array_to_string({c}, ' ')", w) for c, w in directory.FIELD_WEIGHTS.items())


@query("faculty_search_text", sql(PEOPLE, body=f"SELECT faculty_id, full_name AS name, CAST({_SCORE} AS INTEGER) AS score FROM fac WHERE {_SCORE} > 0"))
def _(r: Roles):
    return directory.search_text(r.people, "computing sampling")


@query("unit_search", "SELECT DISTINCT dept_id, name FROM departments WHERE regexp_matches(name, 'of.*com', 'i') ORDER BY name, dept_id LIMIT 5")
def _(r: Roles):
    return directory.search_units(r.departments, "of com")


# research


@query("timeline_top3", sql(WORKS, body="""SELECT kerberos, publication_year, n_papers, string_agg(paper_id, ',' ORDER BY k) AS top_papers FROM (
  SELECT kerberos, publication_year, paper_id, count(*) OVER (PARTITION BY kerberos, publication_year) AS n_papers, row_number() OVER (PARTITION BY kerberos, publication_year ORDER BY citation_count DESC NULLS LAST, paper_id) AS k
  FROM pap WHERE trim(kerberos) <> '' AND publication_year IS NOT NULL) WHERE k <= 3 GROUP BY ALL"""))
def _(r: Roles):
    return research.timeline(r.works)


@query("research_facets", sql(WORKS, body="SELECT kerberos, CAST(sum(n) AS BIGINT) AS total_papers, count(*) AS total_years, count(publication_year) AS timeline_years FROM (SELECT kerberos, publication_year, count(*) AS n FROM pap WHERE trim(kerberos) <> '' GROUP BY ALL) GROUP BY ALL"))
def _(r: Roles):
    return research.facets(r.works)


@query("publications_page", sql(WORKS, body="SELECT paper_id, title, publication_year, coalesce(citation_count, 0) AS citation_count FROM pap WHERE kerberos = 'repodesk' AND publication_year = 2021 ORDER BY pap.citation_count DESC NULLS LAST, paper_id LIMIT 20 OFFSET 5"))
def _(r: Roles):
    return research.publications(r.works, "repodesk", [], 2021, 5, 20)


_SUBJECTS = """subj AS (SELECT *, row_number() OVER (PARTITION BY expert_id ORDER BY n_papers DESC, subject) AS rank FROM (
  SELECT expert_id, trim(subject) AS subject, max(n) AS n_papers FROM (
    SELECT f.expert_id, s.subject, s.n FROM (SELECT kerberos, subject, count(*) AS n FROM (SELECT kerberos, unnest(subject_area) AS subject FROM pap WHERE trim(kerberos) <> '') GROUP BY ALL) s JOIN fac f USING (kerberos)
    UNION ALL SELECT expert_id, subject, count(*) FROM (SELECT expert_id, author_id, unnest(subject_area) AS subject FROM (SELECT unnest(authors).author_id AS author_id, subject_area FROM pap) JOIN (SELECT DISTINCT expert_id, unnest(scopus_id) AS author_id FROM fac) USING (author_id) WHERE trim(author_id) <> '') GROUP BY expert_id, author_id, subject)
  WHERE trim(subject) <> '' GROUP BY ALL) QUALIFY rank <= 8)"""


@query("subject_areas_top8", sql(PEOPLE, WORKS, _SUBJECTS, body="SELECT expert_id, subject, n_papers, rank FROM subj"))
def _(r: Roles):
    return research.subjects(r.works, r.people)


@query("research_areas", sql(PEOPLE, WORKS, _SUBJECTS, _AREAS.format(_BUCKETS + " UNION ALL SELECT faculty_id, 6, subj.subject, rank FROM fac JOIN subj USING (expert_id)"), body="SELECT faculty_id, coalesce(array_to_string(areas, '|'), '') AS research_areas FROM fac LEFT JOIN area USING (faculty_id)"))
def _(r: Roles):
    return research.research_areas(r.people, research.subjects(r.works, r.people))


_H = """cited AS (SELECT author_id, c, row_number() OVER (PARTITION BY author_id ORDER BY c DESC) AS k FROM (SELECT unnest(authors).author_id AS author_id, coalesce(citation_count, 0) AS c FROM pap) WHERE author_id <> ''),
h AS (SELECT author_id, count(*) AS n_papers, CAST(sum(c) AS BIGINT) AS n_citations, CAST(coalesce(max(k) FILTER (WHERE c >= k), 0) AS BIGINT) AS h_index FROM cited GROUP BY ALL)"""


@query("h_index", sql(WORKS, _H, body="SELECT author_id, n_papers, n_citations, h_index FROM h"))
def _(r: Roles):
    return research.h_index(r.works)


@query(
    "metric_source_priority",
    sql(PEOPLE, WORKS, _H, body="""SELECT faculty_id, CASE WHEN p THEN 'profile' WHEN h2 IS NOT NULL THEN 'papers' ELSE 'skip' END AS source, CASE WHEN NOT coalesce(p, false) THEN h2 END AS new_h_index, CASE WHEN NOT coalesce(p, false) THEN c2 END AS new_citations
  FROM (SELECT f.faculty_id, len(list_filter(google_scholar_id, lambda x: trim(x) <> '')) > 0 AS p, h.h_index AS h2, h.n_citations AS c2 FROM fac f LEFT JOIN h ON h.author_id = split_part(list_filter(f.scopus_id, lambda x: trim(x) <> '')[1], '&', 1)
  WHERE coalesce(f.h_index, 0) = 0 OR coalesce(f.citation_count, 0) = 0)"""),
)
def _(r: Roles):
    return research.metric_sources(r.people, research.h_index(r.works))


@query(
    "stored_paper_totals",
    sql(PEOPLE, WORKS, body="""SELECT f.faculty_id, CAST(coalesce(a, 0) + coalesce(b, 0) AS BIGINT) AS n_stored, coalesce(a, 0) + coalesce(b, 0) >= 10 AS enough FROM fac f
  LEFT JOIN (SELECT kerberos, count(*) AS a FROM pap WHERE document_eid LIKE 'scholar\\_%' ESCAPE '\\' AND trim(kerberos) <> '' GROUP BY ALL) USING (kerberos)
  LEFT JOIN (SELECT faculty_id, sum(n) AS b FROM (SELECT faculty_id, unnest(scopus_id) AS author_id FROM fac) JOIN (SELECT author_id, count(*) AS n FROM (SELECT unnest(authors).author_id AS author_id FROM pap) GROUP BY ALL) USING (author_id) GROUP BY ALL) USING (faculty_id)""".replace("\\\\", "\\")),
)
def _(r: Roles):
    return research.stored_totals(r.works, r.people)


@query("coauthor_counts", sql(WORKS, "w AS (SELECT paper_id, u.author_id AS author_id, lower(trim(u.author_name)) AS name FROM (SELECT paper_id, unnest(authors) AS u FROM pap))", body="SELECT a.author_id, count(DISTINCT b.name) AS n_coauthors FROM w a JOIN w b USING (paper_id) WHERE a.author_id <> b.author_id AND a.name <> b.name GROUP BY ALL"))
def _(r: Roles):
    return research.coauthors(r.works)


@query("collaborators", sql(WORKS, "w AS (SELECT DISTINCT paper_id, lower(trim(u.faculty_ref)) AS f FROM (SELECT paper_id, unnest(iitd_authors) AS u FROM pap) WHERE trim(u.faculty_ref) <> '')", body="SELECT a.f AS faculty_a, b.f AS faculty_b, count(*) AS n_papers FROM w a JOIN w b USING (paper_id) WHERE a.f < b.f GROUP BY ALL"))
def _(r: Roles):
    return research.collaborators(r.works)


@query("year_histogram", sql(WORKS, body="SELECT publication_year, count(*) AS n_papers FROM pap GROUP BY ALL"))
def _(r: Roles):
    return research.year_histogram(r.works)


# maintenance plans


@query("find_or_create_units", "SELECT DISTINCT upper(trim(department_code)) AS code FROM faculty_upsert WHERE trim(department_code) <> '' AND upper(trim(department_code)) NOT IN (SELECT upper(code) FROM departments)")
def _(r: Roles):
    return maintain.new_units(r.t("faculty_upsert").select(F.col("department_code").alias("code")), r.departments)


_COLUMNS = ["title", "firstName", "lastName", "email", "gender", "designation", "working_from_year", "h_index", "citation_count"]


@query(
    "upsert_plan",
    sql(PEOPLE, body="SELECT coalesce(o.email, n.email) AS email, " + ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" if c in ("working_from_year", "h_index", "citation_count") else f"coalesce(o.{c}, n.{c}) AS {c}" if c == "gender" else f"coalesce(nullif(n.{c}, ''), o.{c}) AS {c}" for c in _COLUMNS if c != "email")
        + ", CASE WHEN o.email IS NULL THEN 'insert' WHEN n.email IS NOT NULL AND (" + " OR ".join((f"coalesce(n.{c}, o.{c})" if c in ("working_from_year", "h_index", "citation_count") else f"coalesce(nullif(n.{c}, ''), o.{c})") + f" IS DISTINCT FROM o.{c}" for c in _COLUMNS if c not in ("email", "gender")) + ") THEN 'update' ELSE 'none' END AS action FROM (SELECT * FROM fac QUALIFY row_number() OVER (PARTITION BY email ORDER BY faculty_id) = 1) o FULL JOIN (SELECT * FROM faculty_upsert QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_key) = 1) n ON o.email = n.email"),
)
def _(r: Roles):
    from pyspark.sql import Window

    first = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy("email").orderBy(order))).filter("_n = 1")
    return maintain.upsert(first(r.people, "faculty_id"), first(r.t("faculty_upsert"), "row_key"), "email", [c for c in _COLUMNS if c != "email"], ("gender",))


_KIND = rf"CASE WHEN NOT coalesce(regexp_matches(trim(email), '^[^@\s]+@[^@\s]+\.[^@\s]+$'), false) THEN 'invalid' WHEN lower(split_part(trim(email), '@', -1)) = '{DOMAIN}' THEN 'central' WHEN regexp_matches(lower(split_part(trim(email), '@', -1)), '^[^.]+\.{DOMAIN.replace('.', chr(92) + '.')}$') THEN 'department' ELSE 'other' END"


@query("email_kinds", sql(PEOPLE, body=f"SELECT {_KIND} AS kind, count(*) AS n FROM fac GROUP BY ALL"))
def _(r: Roles):
    return r.people.groupBy(maintain.email_kind(F.col("email"), DOMAIN).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "email_collision_plan",
    sql(PEOPLE, body=f"""SELECT faculty_id, email, new_email, CASE WHEN EXISTS (SELECT 1 FROM fac g WHERE lower(g.email) = new_email AND g.faculty_id <> h.faculty_id) THEN 'collision' ELSE 'update' END AS action
  FROM (SELECT faculty_id, email, lower(kerberos || '@' || code || '.{DOMAIN}') AS new_email FROM home WHERE {_KIND} = 'central') h"""),
)
def _(r: Roles):
    return maintain.email_plan(r.people, r.departments, DOMAIN)


@query(
    "reconcile_plan",
    sql(PEOPLE, body="""SELECT row_key, kerberos, faculty_id, dept_id AS new_dept_id, CASE WHEN reason <> '' THEN 'skip' WHEN own IS NOT DISTINCT FROM dept_id THEN 'none' ELSE 'update' END AS action, reason FROM (
  SELECT u.row_key, u.kerberos, p.faculty_id, n.dept_id, p.own, CASE WHEN coalesce(u.code, '') = '' THEN 'no unit given' WHEN n.dept_id IS NULL THEN 'unknown unit' WHEN p.faculty_id IS NULL THEN 'unknown person' ELSE '' END AS reason
  FROM (SELECT row_key, lower(trim(split_part(email, '@', 1))) AS kerberos, upper(trim(department_code)) AS code FROM faculty_upsert) u LEFT JOIN names n ON n.ref = u.code
  LEFT JOIN (SELECT kerberos, faculty_id, names.dept_id AS own FROM fac LEFT JOIN names ON ref = unit_ref QUALIFY row_number() OVER (PARTITION BY kerberos ORDER BY faculty_id) = 1) p USING (kerberos))"""),
)
def _(r: Roles):
    rows = r.t("faculty_upsert").select("row_key", F.substring_index("email", "@", 1).alias("kerberos"), "department_code")
    return maintain.reconcile(rows, r.people, r.departments)


_LISTED = "listed AS (SELECT DISTINCT departmentId AS dept_id, unnest(facultyIds) AS faculty_id FROM department_sheet_roster WHERE departmentId <> '')"


def _listed(r: Roles):
    return r.t("department_sheet_roster").filter("departmentId <> ''").select(F.col("departmentId").alias("dept_id"), F.explode("facultyIds").alias("faculty_id")).distinct()


@query("affiliation_plan", sql(PEOPLE, _LISTED, body="SELECT faculty_id, l.dept_id FROM listed l JOIN fac f USING (faculty_id) WHERE NOT coalesce(list_contains(list_append(coalesce(f.affiliations, []), f.department), l.dept_id), false)"))
def _(r: Roles):
    return maintain.add_affiliations(r.people, _listed(r))


@query("listed_without_record", sql(PEOPLE, _LISTED, body="SELECT DISTINCT faculty_id FROM listed WHERE faculty_id NOT IN (SELECT faculty_id FROM fac)"))
def _(r: Roles):
    return maintain.unlisted(_listed(r), r.people)


@query("year_backfill_plan", sql(WORKS, body="SELECT o.paper_id, o.y AS old_year, p.publication_year AS new_year FROM (SELECT paper_id, year(createdAt)::INTEGER AS y FROM pap) o JOIN pap p USING (paper_id) WHERE p.publication_year BETWEEN 1900 AND 2200 AND o.y IS DISTINCT FROM p.publication_year"))
def _(r: Roles):
    return maintain.year_backfill(r.works.select("paper_id", F.year("createdAt").alias("year")), r.works)


@query("rejected_records", "SELECT suggestion_id, concat_ws('; ', CASE WHEN NOT coalesce(trim(name) <> '', false) THEN 'name is missing' END, CASE WHEN NOT coalesce(regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false) THEN 'email is invalid' END) AS messages FROM (SELECT DISTINCT * FROM suggestion) WHERE messages <> ''".replace("\\\\", "\\"))
def _(r: Roles):
    rules = {"name is missing": F.trim("name") != "", "email is invalid": F.regexp_like("email", F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))}
    return maintain.rejected(r.t("suggestion").distinct(), rules).select("suggestion_id", "messages")


# profile papers


@query("profile_title_fits", "SELECT s.row_key, CAST(count(*) AS BIGINT) AS n_fits FROM (SELECT row_key, title, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS k FROM scholar_papers) s JOIN (SELECT DISTINCT paper_id, title, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS k FROM researchmetadatascopus) p USING (k) WHERE len(list_filter(regexp_split_to_array(lower(s.title), '\\s+'), lambda w: length(w) > 3)) = 0 OR len(list_filter(list_filter(regexp_split_to_array(lower(s.title), '\\s+'), lambda w: length(w) > 3), lambda w: contains(lower(p.title), w))) / len(list_filter(regexp_split_to_array(lower(s.title), '\\s+'), lambda w: length(w) > 3)) >= 0.6 GROUP BY ALL".replace("\\\\", "\\"))
def _(r: Roles):
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "")
    s = r.t("scholar_papers").select("row_key", F.col("title").alias("wanted"), key.alias("k"))
    p = r.t("researchmetadatascopus").select("paper_id", F.col("title").alias("offered"), key.alias("k")).distinct()
    return s.join(p, "k").filter(title_fits(F.col("wanted"), F.col("offered"))).groupBy("row_key").agg(F.count(F.lit(1)).alias("n_fits"))


@query(
    "profile_title_overlaps",
    r"""WITH s AS (SELECT row_key, list_filter(regexp_split_to_array(lower(title), '\s+'), lambda w: length(w) > 3) AS w FROM scholar_papers WHERE title IS NOT NULL),
p AS (SELECT lower(title) AS title, count(*) AS n FROM (SELECT DISTINCT paper_id, title FROM researchmetadatascopus WHERE title IS NOT NULL) GROUP BY ALL)
SELECT row_key, CAST(sum(n) AS BIGINT) AS n_fits FROM s, p WHERE len(w) = 0 OR len(list_filter(w, lambda x: contains(p.title, x))) / len(w) >= 0.6 GROUP BY ALL""",
)
def _(r: Roles):
    return search.fit_counts(r.t("scholar_papers"), r.t("researchmetadatascopus"))
