"""The index that text queries are answered from holds their terms and no others; a frequent term's postings are dealt out."""

from pyspark.sql import functions as F

from conftest import SF, same_as_oracle
from seekframe.operators import lexical
from seekframe.plans import catalogue, queries, stored


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_terms_of_the_queries_only(spark):
    asked = queries.text_queries(spark)
    terms = lexical.asked(asked)
    whole, some = stored.index(spark, SF, F.lit("all")), stored.index(spark, SF, F.lit("all"), asked)
    assert rows(some[0]) == rows(whole[0])
    for a, b in zip(some[1:], whole[1:], strict=True):
        assert rows(a) == rows(b.where(F.col("term").isin(terms))) != []
    assert some[1].count() * 4 < whole[1].count()


def test_queries_build_no_more(spark, duck, monkeypatch):
    build, seen = lexical.build, []
    monkeypatch.setattr(stored, "_KNOWN", {})
    monkeypatch.setattr(lexical, "build", lambda files, windows=1, wanted=None: seen.append(wanted) or build(files, windows, wanted))
    for name in ("lexical_min_should_match", "hit_mrr_at_k", "rrf_fusion"):
        same_as_oracle(spark, duck, catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert seen == [lexical.asked(queries.text_queries(spark))]


def test_frequent_terms_are_dealt_out(spark):
    one = spark.range(4000).select(F.lit("p").alias("project"), F.concat(F.lit("f"), "id").alias("path"), F.lit("content").alias("field"), F.lit(9).alias("size"), F.lit("the").alias("term"), F.lit(1).alias("tf"))
    held = lexical.stored(lexical.in_windows(one, 64))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together again
    try:
        assert held.select(F.spark_partition_id()).distinct().count() > 1 and held.count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
