"""Per-person knowledge graphs, the term explorer, and lookup indices of paper positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import holds, or_default
from ..session import cut

# ---- fixed values: labels that stand for a missing one ----
PLACEHOLDER_LABELS = ("Unclassified", "Research Topic", "Unknown Theme", "Unknown Domain", "Unknown Sub-Domain", "Unknown Dept")
#: Those that get no node in a person's graph; the others do, though the explorer leaves them out.
GRAPH_EXCLUDED = ("Unclassified", "Unknown Domain")
TERM_TYPES = ("theme", "domain", "subdomain", "topic")


def labelled(works: DataFrame) -> DataFrame:
    """Works with stand-ins for missing labels."""
    return works.select(
        "paper_id", "title", "publication_year", "citation_count", or_default(F.col("theme"), "Unknown Theme").alias("theme"), or_default(F.col("domain"), "Unknown Domain").alias("domain"),
        or_default(F.col("subdomain"), "Unknown Sub-Domain").alias("subdomain"), or_default(F.col("topic"), "Research Topic").alias("topic"),
    )


def graph_edges(owned: DataFrame, works: DataFrame) -> DataFrame:
    """Edges of every person's graph: faculty_id, source, target, label; none is dropped as a repeat."""
    w = owned.join(labelled(works), "paper_id")
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    person, paper = node("f:", "faculty_id"), node("p:", "paper_id")
    chain = [(person, paper, "AUTHORED", None), (paper, node("theme:", "theme"), "BELONGS_TO", "theme"), (paper, node("dom:", "domain"), "IN_DOMAIN", "domain"), (paper, node("sd:", "subdomain"), "IN_SUBDOMAIN", "subdomain"), (paper, node("topic:", "topic"), "HAS_TOPIC", "topic")]
    # one pass over the works: an array of edges per row, exploded
    edges = F.array(*[F.when(F.lit(True) if c is None else ~F.col(c).isin(*GRAPH_EXCLUDED), F.struct(s.alias("source"), t.alias("target"), F.lit(label).alias("label"))) for s, t, label, c in chain])
    return w.select("faculty_id", F.explode(F.array_compact(edges)).alias("e")).select("faculty_id", "e.source", "e.target", "e.label")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of every person's graph, each once: faculty_id, node_id, kind."""
    kinds = {"f": "faculty", "p": "paper", "theme": "theme", "dom": "domain", "sd": "subdomain", "topic": "topic"}
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    ends = edges.select("faculty_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.withColumn("kind", kind[F.substring_index("node_id", ":", 1)])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("faculty_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("kind") == "paper").alias("n_papers"))
    e = edges.groupBy("faculty_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("label") == "IN_DOMAIN").alias("n_classified"))
    return n.join(e, "faculty_id")


def term_cells(owned: DataFrame, works: DataFrame, homes: DataFrame) -> DataFrame:
    """Papers per type, term, unit and person: the base of the explorer; labels that stand for missing ones are left out."""
    terms = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("term")) for t in TERM_TYPES])
    rows = owned.join(labelled(works), "paper_id").join(homes, "faculty_id").select("faculty_id", "paper_id", "unit_name", F.explode(terms).alias("t"))
    kept = rows.filter(~F.col("t.term").isin(*PLACEHOLDER_LABELS))
    return kept.groupBy("t.type", "t.term", "unit_name", "faculty_id").agg(F.count(F.lit(1)).alias("n_papers"))


def explore_detail(cells: DataFrame) -> DataFrame:
    """Per term and unit: papers, people, and the people from most to fewest papers."""
    people = F.array_sort(F.collect_list(F.struct((-F.col("n_papers")).alias("k"), "faculty_id")))
    return cells.groupBy("type", "term", "unit_name").agg(F.sum("n_papers").alias("n_papers"), F.count(F.lit(1)).alias("n_faculty"), F.array_join(F.transform(people, lambda x: x["faculty_id"]), ",").alias("faculty_ids"))


def explore_terms(cells: DataFrame) -> DataFrame:
    """Per term: papers, units, and people summed over units."""
    return cells.groupBy("type", "term").agg(F.sum("n_papers").alias("n_papers"), F.countDistinct("unit_name").alias("n_units"), F.count(F.lit(1)).alias("n_faculty"))


def list_terms(terms: DataFrame, query: str = "", kind: str = "", limit: int = 40) -> DataFrame:
    """Terms by type order and number of papers; without query and kind only themes, domains and sub-domains."""
    order = F.create_map(*[x for i, t in enumerate(TERM_TYPES) for x in (F.lit(t), F.lit(i))])
    rows = terms.filter(F.col("type") == kind) if kind else terms if query else terms.filter(F.col("type") != "topic")
    rows = rows.filter(holds(F.col("term"), query)) if query else rows
    return rows.orderBy(order[F.col("type")], F.col("n_papers").desc(), "term").limit(max(1, min(200, limit)))


def positions(works: DataFrame) -> DataFrame:
    """A dense position from 0 in the order of paper_id: i, paper_id.

    Rows are range-partitioned and numbered within their partition; only the sizes
    (one per partition) go through the driver and come back as a small table, so no
    task sees more than its own range.
    """
    spark = works.sparkSession
    ids = cut(works.select("paper_id").repartitionByRange("paper_id").sortWithinPartitions("paper_id").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in ids.groupBy("part").count().collect())
    starts, start = [], 0
    for part, n in sizes:
        starts.append((part, start))
        start += n
    table = spark.createDataFrame(starts, "part int, start bigint")
    w = Window.partitionBy("part").orderBy("paper_id")
    numbered = ids.withColumn("k", F.row_number().over(w))
    return numbered.join(F.broadcast(table), "part").select((F.col("start") + F.col("k") - 1).cast("bigint").alias("i"), "paper_id")


def indices_of(owned: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """The sorted positions per person or unit, with their number."""
    return owned.join(places, "paper_id").groupBy(key).agg(F.array_sort(F.collect_set("i")).alias("s")).select(key, F.size("s").cast("bigint").alias("n"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("indices"))


def union_of(indices: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [x.select("i") for x in indices]).distinct()


def first_rows(sheet: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key in input order; blank keys are no keys."""
    w = Window.partitionBy(key).orderBy(order)
    return sheet.filter(F.trim(key) != "").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
