"""Document deduplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.dedup import dedup_decisions
from millrace.plans.registry import query
from millrace.sources.tables import table

# A third of the documents get trailing blanks, so that the normalised branch is exercised.
_VARIANTS_SQL = """
  WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '  ' ELSE text END AS text FROM documents),
  n AS (SELECT doc_id, text, sha256(text) AS raw,
               sha256(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g')) AS norm FROM v),
  f AS (SELECT norm, min(doc_id) AS retained_id FROM n GROUP BY norm),
  d AS (SELECT n.doc_id AS source_id, f.retained_id,
               CASE WHEN n.doc_id = f.retained_id THEN 'retained'
                    WHEN n.raw = o.raw THEN 'exact_match' ELSE 'normalized_match' END AS reason
        FROM n JOIN f USING (norm) JOIN n o ON o.doc_id = f.retained_id)
"""


def _variants(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("  "))).otherwise(F.col("text")).alias("text"),
    )


@query("dedup_decisions", _VARIANTS_SQL + "SELECT source_id, retained_id, reason FROM d")
def decisions(spark, sf_dir):
    return dedup_decisions(_variants(spark, sf_dir))


@query("dedup_reasons", _VARIANTS_SQL + "SELECT reason, count(*) AS n FROM d GROUP BY reason")
def reasons(spark, sf_dir):
    return dedup_decisions(_variants(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))
