"""File sources: spreadsheets as CSV, CSV with free headers, JSON, folders of JSON, and stored outside profiles."""

from __future__ import annotations

import re
import zipfile
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import strip, title_fits

# ---- fixed values: accepted spellings of headers ----
HEADERS = {"kerberos": ("kerberos_id", "kerberos", "kerb", "id", "username"), "department_code": ("department_code", "dept_code", "department", "dept", "code")}

PROFILE = StructType(
    [
        StructField("source", StringType()), StructField("scholarId", StringType()), StructField("name", StringType()), StructField("affiliation", StringType()), StructField("citations", IntegerType()), StructField("hIndex", IntegerType()),
        StructField("papers", ArrayType(StructType([StructField("title", StringType()), StructField("year", IntegerType()), StructField("citations", IntegerType()), StructField("type", StringType()), StructField("venue", StringType()), StructField("authors", ArrayType(StringType()))]))),
    ]
)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """Quoted cells with doubled quotes and line breaks, any line ends; cells stripped, rows without any value dropped, all text."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cells = raw.select(*[F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])
    return cells.dropna("all")


def header(name: str) -> str:
    """A header in lower case with underscores."""
    return re.sub(r"\s+", "_", name.strip().lower())


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]] = HEADERS) -> DataFrame:
    """The wanted columns under their own names: of each, the first column of the table whose header is any of its aliases; an error names the missing one."""
    out = []
    for wanted, names in aliases.items():
        column = next((c for c in df.columns if header(c) in names), None)
        if column is None:
            raise ValueError(f"no column for {wanted} among {', '.join(df.columns)}")
        out.append(F.col(f"`{column}`").alias(wanted))
    return df.select(*out)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook file (.xlsx) by name, all cells as text, the first row as header; empty cells are null. A workbook is a file of the office world that one machine reads: the driver parses it."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for entry in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = targets[entry.get(_LINK)].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
                cells = {}
                for k, c in enumerate(row.findall(f"{_SHEET}c")):
                    letters = "".join(x for x in c.get("r", "") if x.isalpha())
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                    value = c.findtext(f"{_SHEET}v")
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else value
                rows.append(cells)
            if rows:
                names = [(k, v) for k, v in sorted(rows[0].items()) if v]
                schema = StructType([StructField(v, StringType()) for _, v in names])
                out[entry.get("name")] = spark.createDataFrame([tuple(r.get(k) for k, _ in names) for r in rows[1:]], schema)
    return out


def names_by_department(sheet: DataFrame, department: str, name: str) -> DataFrame:
    """The people a sheet lists per department: department, names in order of the alphabet, each once; blank cells are none."""
    rows = sheet.select(strip(F.col(department)).alias("department"), strip(F.col(name)).alias("name")).filter("department <> '' AND name <> ''")
    return rows.groupBy("department").agg(F.array_sort(F.collect_set("name")).alias("names"))


def fetched_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Stored profiles (one JSON file each) as papers: scholar_id, title, year, citations. A file that is no profile, or has an error, is as if it had not been fetched."""
    rows = json_folder(spark, folder, PROFILE).filter(F.col("scholarId").isNotNull() & F.col("papers").isNotNull())
    return rows.select(F.col("scholarId").alias("scholar_id"), F.explode("papers").alias("p")).select("scholar_id", "p.title", "p.year", "p.citations")


def sheets(tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """Sheets of a workbook (already tables) under one another by column name, with the sheet's name; missing cells are ''. A sheet without a required column is an error."""
    for name, df in tables.items():
        if missing := [c for c in required if c not in df.columns]:
            raise ValueError(f"sheet {name} lacks {', '.join(missing)}")
    rows = [df.select(F.lit(name).alias("sheet"), *required) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).fillna("")


def json_file(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_folder(spark: SparkSession, folder: str, schema: StructType | None = None) -> DataFrame:
    """Every *.json of a folder but index.json, with its file name."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json")
    df = (reader.schema(schema) if schema else reader).json(folder).select("*", F.col("_metadata.file_name").alias("file_name"))
    return df.filter("file_name <> 'index.json'")


def roster(spark: SparkSession, path: str) -> DataFrame:
    """Listed people of a roster file: unit key, dept_id, faculty_id."""
    entry = StructType([StructField("departmentId", StringType()), StructField("sheetUnitName", StringType()), StructField("facultyIds", ArrayType(StringType()))])
    from pyspark.sql.types import MapType

    df = json_file(spark, path, StructType([StructField("departments", MapType(StringType(), entry))]))
    return df.select(F.explode("departments").alias("unit", "v")).select("unit", F.col("v.departmentId").alias("dept_id"), F.explode("v.facultyIds").alias("faculty_id"))


def author_list(text: Column) -> Column:
    """Names of an author string, parted by commas or 'and'."""
    return F.filter(F.transform(F.split(text, r",|\s+and\s+"), strip), lambda x: x != "")


def author_positions(names: Column) -> Column:
    """first, middle or last for every author in order; a single author is first."""
    n = F.size(names)
    return F.transform(names, lambda x, i: F.struct(x.alias("author_name"), F.when(i == 0, "first").when(i == n - 1, "last").otherwise("middle").alias("author_position")))


def resolved_abstracts(works: DataFrame, by_doi: DataFrame, by_title: DataFrame, share: float = 0.6) -> DataFrame:
    """Abstracts by stored look-ups in order of trust: the DOI's, else that of a title that fits. by_doi: doi, abstract; by_title: paper_id, offered, abstract."""
    titled = works.select("paper_id", "title").join(by_title, "paper_id").filter(title_fits(F.col("title"), F.col("offered"), share)).groupBy("paper_id").agg(F.min(F.struct("offered", "abstract")).alias("t"))
    dois = by_doi.groupBy("doi").agg(F.min("abstract").alias("by_doi"))
    return works.join(dois, "doi", "left").join(titled, "paper_id", "left").select("paper_id", F.coalesce(F.nullif("by_doi", F.lit("")), F.nullif("t.abstract", F.lit(""))).alias("abstract"))
