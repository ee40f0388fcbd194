"""The subpackage's queries by name, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seekframe.llm.bpe import op4_bpe_round_trip
from seekframe.llm.collocations import OP12_SQL, op12_collocations
from seekframe.llm.embedding_dedup import OP5_SQL, op5_embedding_dedup
from seekframe.llm.licenses import OP7_SQL, op7_license_scan
from seekframe.llm.mixing import op6_source_mix
from seekframe.llm.ngram_join import OP2_SQL, op2_ngram_join
from seekframe.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from seekframe.llm.quality import op10_quality_classifier
from seekframe.llm.scratch import ship
from seekframe.llm.secrets import OP9_SQL, op9_secret_scan
from seekframe.llm.sharding import op13_sharding
from seekframe.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from seekframe.llm.topk_search import OP3_SQL, op3_topk_search
from seekframe.llm.url_filter import op8_url_filter

QUERIES = (op1_substring_dedup, op2_ngram_join, op3_topk_search, op4_bpe_round_trip, op5_embedding_dedup, op6_source_mix, op7_license_scan, op8_url_filter, op9_secret_scan, op10_quality_classifier, op11_prefix_trie, op12_collocations, op13_sharding)
ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op2_ngram_join": OP2_SQL,
    "op3_topk_search": OP3_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op7_license_scan": OP7_SQL,
    "op9_secret_scan": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
