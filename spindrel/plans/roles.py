"""The tables in the roles the directory queries speak of, and the same as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, identity
from ..session import tune
from ..sources.tables import table


class Roles:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = tune(spark), sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def departments(self) -> DataFrame:
        return self.t("departments")

    @cached_property
    def people(self) -> DataFrame:
        return identity.people(self.t("faculty"))

    @cached_property
    def works(self) -> DataFrame:
        return identity.works(self.t("researchmetadatascopus"))

    @cached_property
    def labelled_works(self) -> DataFrame:
        return identity.label_names(self.works, self.t("themes"), self.t("domains"))

    @cached_property
    def owned(self) -> DataFrame:
        return identity.owners(self.works.select("paper_id", "iitd_authors", "authors", "kerberos"), self.people)

    @cached_property
    def homes(self) -> DataFrame:
        return identity.with_unit(self.people, self.departments).select("faculty_id", "unit_name")

    @cached_property
    def places(self) -> DataFrame:
        """Numbered once per query."""
        return graph.positions(self.works)

    @cached_property
    def points(self) -> DataFrame:
        return self.labelled_works.select("paper_id", "title", "theme", "domain", "subdomain", "topic", F.col("publication_year").alias("year"), "citation_count").join(self.places, "paper_id")

    @cached_property
    def unit_points(self) -> DataFrame:
        """Positions by unit of the papers' people."""
        return self.owned.join(self.homes, "faculty_id").join(self.places, "paper_id").select("i", "unit_name").distinct()


_ID = r"CASE WHEN regexp_matches(lower({0}), '(^|[^0-9a-f])[0-9a-f]{{24}}($|[^0-9a-f])') THEN regexp_extract(lower({0}), '(^|[^0-9a-f])([0-9a-f]{{24}})($|[^0-9a-f])', 2) ELSE '' END"
_REF = r"CASE WHEN " + _ID + r" <> '' THEN " + _ID + r" ELSE upper(regexp_replace({0}, 'objectid|\$oid|[^A-Za-z0-9]', '', 'gi')) END"


def ref_sql(column: str) -> str:
    return _REF.format(column)


def id_sql(column: str) -> str:
    return _ID.format(column)


PEOPLE = f"""
dep AS (SELECT DISTINCT dept_id, name, code, category FROM departments),
names AS (SELECT lower(dept_id) AS ref, dept_id FROM dep UNION SELECT upper(code), dept_id FROM dep),
fac AS (SELECT *, trim(concat_ws(' ', nullif(firstName, ''), nullif(lastName, ''))) AS full_name, lower(split_part(email, '@', 1)) AS kerberos, {ref_sql('department')} AS unit_ref
  FROM (SELECT DISTINCT * FROM faculty)),
home AS (SELECT f.*, d.dept_id, d.name AS unit_name, d.code, d.category FROM fac f JOIN names n ON n.ref = f.unit_ref JOIN dep d USING (dept_id)),
refs AS (SELECT f.faculty_id, {ref_sql('x')} AS ref FROM (SELECT faculty_id, unnest(list_append(coalesce(affiliations, []), department)) AS x FROM fac) f),
member AS (SELECT DISTINCT f.*, d.dept_id, d.name AS unit_name, d.code, d.category FROM refs r JOIN names n USING (ref) JOIN dep d USING (dept_id) JOIN fac f USING (faculty_id))"""
WORKS = f"""
pap AS (SELECT * FROM researchmetadatascopus QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at) = 1),
lab AS (SELECT p.*, coalesce(t.name, '') AS theme, coalesce(d.name, '') AS domain, coalesce(p.classification.topics[1], '') AS topic, coalesce(p.classification.subdomain_id, '') AS subdomain
  FROM pap p LEFT JOIN (SELECT lower(id) AS id, max(name) AS name FROM themes GROUP BY 1) t ON t.id = {id_sql('p.classification.thematic_area_id')}
  LEFT JOIN (SELECT lower(id) AS id, max(name) AS name FROM domains GROUP BY 1) d ON d.id = {id_sql('p.classification.domain_id')}),
place AS (SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS i FROM pap)"""
OWNED = f"""
own AS (
  SELECT p.paper_id, f.faculty_id FROM (SELECT paper_id, {id_sql('u.faculty_ref')} AS fid FROM (SELECT paper_id, unnest(iitd_authors) AS u FROM pap)) p JOIN fac f ON f.faculty_id = p.fid
  UNION SELECT a.paper_id, s.faculty_id FROM (SELECT paper_id, u.author_id FROM (SELECT paper_id, unnest(authors) AS u FROM pap)) a
    JOIN (SELECT DISTINCT faculty_id, unnest(scopus_id) AS author_id FROM fac) s USING (author_id) WHERE trim(author_id) <> ''
  UNION SELECT p.paper_id, f.faculty_id FROM pap p JOIN fac f ON lower(p.kerberos) = f.kerberos WHERE trim(p.kerberos) <> '' AND f.kerberos <> '')"""
FILLED = """
filled AS (SELECT paper_id, title, CASE WHEN trim(theme) = '' THEN 'Unknown Theme' ELSE trim(theme) END AS theme, CASE WHEN trim(domain) = '' THEN 'Unknown Domain' ELSE trim(domain) END AS domain,
  CASE WHEN trim(subdomain) = '' THEN 'Unknown Sub-Domain' ELSE trim(subdomain) END AS subdomain, CASE WHEN trim(topic) = '' THEN 'Research Topic' ELSE trim(topic) END AS topic FROM lab)"""


def sql(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body
