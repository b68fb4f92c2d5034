"""Splits, quotas, reservations and conflict resolution over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import partition as P
from millrace.plans.registry import query
from millrace.sources.tables import table

CUTS = [("train", 0.7), ("validation", 0.8), ("test", 0.9), ("challenge", 1.0)]
_SHARE = "('0x' || substr(sha256({}::VARCHAR), 1, 16))::UBIGINT / 18446744073709551616.0"
_SPLIT = "CASE WHEN {0} < 0.7 THEN 'train' WHEN {0} < 0.8 THEN 'validation' WHEN {0} < 0.9 THEN 'test' ELSE 'challenge' END"
_ROWS = f"WITH q AS (SELECT doc_id AS id, text, lang, source, n_chars, {_SPLIT.format('(' + _SHARE.format('doc_id') + ')')} AS split FROM documents)"
ORDER = ["challenge", "test", "validation", "train"]
_RANK = "CASE split WHEN 'challenge' THEN 1 WHEN 'test' THEN 2 WHEN 'validation' THEN 3 ELSE 4 END"


def _rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars", P.hash_split(F.col("doc_id"), CUTS).alias("split"))


@query("split_sizes", _ROWS + " SELECT split, count(*) AS n, count(DISTINCT source) AS sources FROM q GROUP BY split")
def split_sizes(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("split_leaks", _ROWS + " SELECT sha256(text) AS k, count(DISTINCT split) AS splits FROM q GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, sf_dir):
    return P.leaking_keys(_rows(spark, sf_dir).withColumn("k", F.sha2("text", 256)), "k", "split")


@query(
    "priority_reservation",
    _ROWS + f", b AS (SELECT sha256(text) AS k, min({_RANK}) AS r FROM q GROUP BY 1) SELECT id, ['challenge', 'test', 'validation', 'train'][r] AS split FROM q JOIN b ON b.k = sha256(text)",
)
def priority_reservation(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("k", F.sha2("text", 256))
    return P.reserve_by_priority(rows, "k", "split", ORDER).select("id", "split")


@query(
    "group_quotas",
    """
WITH RECURSIVE g AS (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY sha256(source), source) AS k
                     FROM documents GROUP BY lang, source),
f AS (SELECT lang, source, n, k, n <= 40 AS taken, CASE WHEN n <= 40 THEN n ELSE 0 END AS used FROM g WHERE k = 1
      UNION ALL SELECT g.lang, g.source, g.n, g.k, f.used + g.n <= 40, CASE WHEN f.used + g.n <= 40 THEN f.used + g.n ELSE f.used END
      FROM f JOIN g ON g.lang = f.lang AND g.k = f.k + 1)
SELECT lang, source, n, taken FROM f
""",
)
def group_quotas(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return P.group_quota(groups, "lang", "source", "n", 40)


@query(
    "capped_classes",
    _ROWS + " SELECT id, lang, split FROM q QUALIFY row_number() OVER (PARTITION BY lang, split ORDER BY sha256('c:' || id), id) <= 10",
)
def capped_classes(spark, sf_dir):
    return P.capped_by_hash(_rows(spark, sf_dir), "id", ["lang", "split"], 10, "c").select("id", "lang", "split")


@query("hash_sample", _ROWS + " SELECT id FROM q ORDER BY sha256('s:' || id), id LIMIT 100")
def hash_sample(spark, sf_dir):
    return P.sample_by_hash(_rows(spark, sf_dir), "id", 100, "s").select("id")


@query(
    "conflict_free",
    _ROWS + ", k AS (SELECT sha256(text) AS k, min(id) AS id, count(DISTINCT split) AS t, count(*) AS copies FROM q GROUP BY 1) SELECT id, copies FROM k WHERE t = 1",
)
def conflict_free(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(F.sha2("text", 256).alias("k"), "id", "split")
    return P.resolve_conflicts(rows, ["k"], "split", "id").select("id", "copies")


@query(
    "consolidated_lineage",
    _ROWS + ", k AS (SELECT sha256(text) AS k, count(DISTINCT lang) AS c, min(lang) AS lang, list_sort(list_distinct(list(source))) AS s FROM q GROUP BY 1) SELECT k, lang, array_to_string(s, ',') AS sources FROM k WHERE c = 1",
)
def consolidated(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(F.sha2("text", 256).alias("k"), "lang", "source")
    return P.consolidate(rows, ["k"], "lang", "source").select("k", "lang", F.array_join("source", ",").alias("sources"))


@query(
    "clean_splits",
    _ROWS + f""", r AS (SELECT *, {_RANK} AS r, n_chars AS g, sha256(text) AS p FROM q),
    o AS (SELECT * FROM r QUALIFY r = min(r) OVER (PARTITION BY g)),
    t AS (SELECT DISTINCT g FROM (SELECT g FROM o QUALIFY r > min(r) OVER (PARTITION BY p)))
    SELECT id, split FROM o WHERE g NOT IN (SELECT g FROM t) QUALIFY row_number() OVER (PARTITION BY p, split ORDER BY id) = 1""",
)
def clean_splits(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("id", "split", F.col("n_chars").alias("g"), F.sha2("text", 256).alias("p"))
    return P.clean_splits(rows, "g", "p", "split", ORDER).select("id", "split")


@query("role_counts", _ROWS + " SELECT split, lang, count(*) AS n FROM q GROUP BY GROUPING SETS ((split, lang), (split), ())")
def role_counts(spark, sf_dir):
    return _rows(spark, sf_dir).groupingSets([["split", "lang"], ["split"], []], "split", "lang").agg(F.count("*").alias("n"))


@query("train_test_overlap", _ROWS + " SELECT a.id FROM q a WHERE a.split = 'train' AND EXISTS (SELECT 1 FROM q b WHERE b.split = 'test' AND b.text = a.text)")
def overlap(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("id", "split", F.sha2("text", 256).alias("k"))
    return rows.where("split = 'train'").join(rows.where("split = 'test'").select("k"), "k", "left_semi").select("id")
