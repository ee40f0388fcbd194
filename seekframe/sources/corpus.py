"""The driver tables as code-corpus tables. The mapping is this project's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.functions.text import scan_estimate
from seekframe.sources.classify import category, language
from seekframe.tables import table

FOLDERS = ("src/test/", "docs/", "src/main/", "src/main/", "src/main/")
SUFFIXES = (".java", ".md", ".kt", ".ts", ".py", ".sql")
KINDS = ("CLASS", "INTERFACE", "RECORD", "ENUM", "ANNOTATION", "METHOD", "CONSTRUCTOR", "TYPE")
TYPE_KINDS = ("CLASS", "INTERFACE", "RECORD", "ENUM", "ANNOTATION", "TYPE")


def _pick(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


def file_path(doc_id: Column) -> Column:
    return F.concat(_pick(doc_id, FOLDERS), F.lit("doc_"), doc_id.cast("string"), _pick(doc_id, SUFFIXES))


def files(spark: SparkSession, sf_dir: str, project: str = "source") -> DataFrame:
    """(project, doc_id, path, language, category, size, hash, tokens, content, lang): a file per document."""
    docs = table(spark, sf_dir, "documents").select(F.col(project).alias("project"), "doc_id", "lang", file_path(F.col("doc_id")).alias("path"), F.col("text").alias("content"))
    size = F.octet_length("content").cast("long")
    return docs.select(
        "project", "doc_id", "path", language(F.col("path")).alias("language"), category(F.col("path")).alias("category"),
        size.alias("size"), F.sha2("content", 256).alias("hash"), scan_estimate(size).alias("tokens"), "content", "lang",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, kind, name, qualified, start_line, end_line, provider): a symbol per part."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("path"),
        _pick(F.col("p_size"), KINDS).alias("kind"),
        name.alias("name"),
        F.concat_ws(".", "p_brand", "p_type", name).alias("qualified"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + 3).alias("end_line"),
        F.lit("builtin").alias("provider"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, provider): each customer imports itself below its region and nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # both are tables of a fixed size
    place = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    customer = table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    return customer.select(F.col("c_name").alias("source"), F.concat_ws(".", "r_name", "n_name", "c_name").alias("target"), F.lit("IMPORTS").alias("kind"), F.lit("builtin").alias("provider"))


def type_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qualified, owner): each nation's file declares a type below its region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    return place.select(F.concat_ws(".", "r_name", "n_name").alias("qualified"), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("owner"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): suppliers import the parts they deliver, as often as they do."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("dst"))


def touched(spark: SparkSession, sf_dir: str, path: Callable[[Column], Column]) -> DataFrame:
    """(commit, path): what each order's lines touch, as often as they do; ``path`` names a part's number."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), path(F.col("l_partkey")).alias("path"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, at, path): the parts that each order changed, without repeats."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("path")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"))
    return line.join(orders, "commit").select("commit", "at", "path")
