"""Metrics, calibration and paired comparison over predictions derived from documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.plans.registry import query
from millrace.sources.tables import table

_P = """
WITH raw AS (SELECT d.doc_id AS id, d.source AS group_id, d.lang AS task, l.toxic AS target, m.model,
               ('0x' || substr(sha256(m.model || ':' || d.doc_id), 1, 8))::UBIGINT / 4294967296.0 AS u
             FROM documents d JOIN labels l USING (doc_id), (VALUES ('base'), ('trained')) m(model)),
pr AS (SELECT id, group_id, task, target, model,
              CASE WHEN model = 'base' THEN u ELSE 0.5 * u + 0.5 * target END AS p FROM raw),
sc AS (SELECT *, (p >= 0.5)::INT AS choice, CASE WHEN target = 1 THEN p ELSE 1 - p END AS hit FROM pr),
s AS (SELECT *, (choice = target)::INT::DOUBLE AS accuracy, -ln(greatest(1e-12, least(1.0, hit))) AS log_loss,
             2 * pow(1 - hit, 2) AS brier FROM sc),
b AS (SELECT * FROM s WHERE model = 'base'), t AS (SELECT * FROM s WHERE model = 'trained')
"""


def predictions(spark, sf_dir, model):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{model}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    u = u.cast("double") / 4294967296.0
    p = u if model == "base" else 0.5 * u + 0.5 * F.col("toxic")
    named = rows.select(
        F.col("doc_id").alias("id"), F.col("source").alias("group_id"), F.col("lang").alias("task"), F.col("toxic").alias("target"), p.alias("p")
    )
    return M.row_scores(named.withColumn("choice", (F.col("p") >= 0.5).cast("int")))


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


SCORES = ("accuracy", "log_loss", "brier")
_MEANS = "round(avg(accuracy), 6) AS accuracy, round(avg(log_loss), 6) AS log_loss, round(avg(brier), 6) AS brier"


@query("metrics_by_task", _P + f"SELECT task, count(*) AS n, {_MEANS} FROM b GROUP BY task")
def by_task(spark, sf_dir):
    return _rounded(M.means(predictions(spark, sf_dir, "base"), "task"), *SCORES)


@query("metrics_by_task_and_group", _P + f"SELECT task, group_id, count(*) AS n, {_MEANS} FROM b GROUP BY GROUPING SETS ((task, group_id), (task), ())")
def by_sets(spark, sf_dir):
    rows = predictions(spark, sf_dir, "base")
    sets = rows.groupingSets([["task", "group_id"], ["task"], []], "task", "group_id")
    return _rounded(sets.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in SCORES]), *SCORES)


@query(
    "metrics_macro",
    _P + f", m AS (SELECT task, avg(accuracy) AS accuracy, avg(log_loss) AS log_loss, avg(brier) AS brier FROM b GROUP BY task) SELECT count(*) AS tasks, {_MEANS} FROM m",
)
def macro(spark, sf_dir):
    return _rounded(M.macro_means(predictions(spark, sf_dir, "base")), *SCORES)


@query(
    "paired_by_task",
    _P + """SELECT b.task, count(*) AS n, round(avg(t.accuracy - b.accuracy), 6) AS accuracy_difference,
            round(avg(t.log_loss - b.log_loss), 6) AS log_loss_difference FROM b JOIN t USING (id) GROUP BY b.task""",
)
def paired_by_task(spark, sf_dir):
    both = M.paired(predictions(spark, sf_dir, "base"), predictions(spark, sf_dir, "trained"))
    return both.groupBy("task").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("accuracy_t") - F.col("accuracy_b")), 6).alias("accuracy_difference"),
        F.round(F.avg(F.col("log_loss_t") - F.col("log_loss_b")), 6).alias("log_loss_difference"),
    )


@query(
    "group_complete_accuracy",
    _P + "SELECT count(*) AS groups, round(avg(c), 6) AS complete, max(n) AS largest FROM (SELECT group_id, bool_and(accuracy = 1)::INT AS c, count(*) AS n FROM t GROUP BY 1)",
)
def group_complete(spark, sf_dir):
    per = predictions(spark, sf_dir, "trained").groupBy("group_id").agg(F.bool_and(F.col("accuracy") == 1).cast("int").alias("c"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("groups"), F.round(F.avg("c"), 6).alias("complete"), F.max("n").alias("largest"))


_BIN = "count(*) AS n, round(avg(p), 6) AS forecast, round(avg(target::DOUBLE), 6) AS observed, round(abs(avg(p) - avg(target::DOUBLE)), 6) AS gap"


@query("reliability_floor", _P + f"SELECT least(floor(p * 10)::INT, 9) AS bin, {_BIN} FROM b GROUP BY 1")
def reliability_floor(spark, sf_dir):
    rows = predictions(spark, sf_dir, "base")
    return _rounded(M.reliability(rows, M.bin_floor(F.col("p"), 10)), "forecast", "observed", "gap")


@query("reliability_edges", _P + f"SELECT {' + '.join(f'(p >= {i / 10})::INT' for i in range(1, 10))} AS bin, {_BIN} FROM b GROUP BY 1")
def reliability_edges(spark, sf_dir):
    rows = predictions(spark, sf_dir, "base")
    return _rounded(M.reliability(rows, M.bin_edges(F.col("p"), 10)), "forecast", "observed", "gap")


@query("reliability_five", _P + f"SELECT {' + '.join(f'(p > {i / 5})::INT' for i in range(1, 5))} AS bin, {_BIN} FROM b GROUP BY 1")
def reliability_five(spark, sf_dir):
    rows = predictions(spark, sf_dir, "base")
    return _rounded(M.reliability(rows, M.bin_closed_above(F.col("p"), 5)), "forecast", "observed", "gap")


@query(
    "calibration_error",
    _P + """, r AS (SELECT task, least(floor(p * 10)::INT, 9) AS bin, count(*) AS n, abs(avg(p) - avg(target::DOUBLE)) AS gap FROM b GROUP BY 1, 2)
    SELECT task, round(sum(n * gap) / sum(n), 6) AS ece FROM r GROUP BY task""",
)
def calibration_error(spark, sf_dir):
    bins = M.reliability(predictions(spark, sf_dir, "base"), M.bin_floor(F.col("p"), 10), "task")
    return _rounded(M.expected_calibration_error(bins, "task"), "ece")


@query(
    "risk_coverage",
    _P + """SELECT threshold::DOUBLE AS threshold, round(avg((greatest(p, 1 - p) >= threshold)::INT), 6) AS coverage,
            round(avg(CASE WHEN greatest(p, 1 - p) >= threshold THEN accuracy END), 6) AS selective_accuracy
            FROM b, (VALUES (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) x(threshold) GROUP BY 1""",
)
def risk_coverage(spark, sf_dir):
    return _rounded(M.risk_coverage(predictions(spark, sf_dir, "base"), [0.7, 0.8, 0.9]), "coverage", "selective_accuracy")


@query(
    "cost_workflows",
    _P + """, g AS (SELECT p, target::DOUBLE AS y, th, c, c + p * least(th, 1.0) AS look FROM b, (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) x(th), (VALUES (0.05::DOUBLE), (0.2::DOUBLE)) z(c)),
    q AS (SELECT th, c, CASE WHEN th = least(th, p, look) THEN th WHEN p = least(th, p, look) THEN y ELSE c + y * least(th, 1.0) END AS paid, least(th, y) AS ideal FROM g)
    SELECT th AS threshold, c AS inspection, round(avg(paid), 6) AS cost, round(avg(ideal), 6) AS ideal, round(avg(paid - ideal), 6) AS regret FROM q GROUP BY 1, 2""",
)
def cost_workflows(spark, sf_dir):
    rows = predictions(spark, sf_dir, "base")
    return _rounded(M.cost_workflow(rows, [0.2, 0.5, 0.8], [0.05, 0.2]), "cost", "ideal", "regret")


@query(
    "temperature_fit",
    _P + """, g AS (SELECT i AS index, 0.05 * pow(400.0, i / 200.0) AS temperature, target, ln(greatest(1e-12, least(1 - 1e-12, p)) / (1 - greatest(1e-12, least(1 - 1e-12, p)))) AS logit FROM b, range(0, 201) r(i)),
    l AS (SELECT index, temperature, avg(-ln(greatest(1e-12, CASE WHEN target = 1 THEN 1 / (1 + exp(-logit / temperature)) ELSE 1 - 1 / (1 + exp(-logit / temperature)) END))) AS loss FROM g GROUP BY 1, 2)
    SELECT index::INT AS index, round(temperature, 6) AS temperature, round(loss, 6) AS loss FROM l ORDER BY round(loss, 12), index LIMIT 1""",
)
def temperature_fit(spark, sf_dir):
    return _rounded(M.temperature_grid(predictions(spark, sf_dir, "base")), "temperature", "loss")


@query(
    "ablation_ceiling",
    _P + ", c AS (SELECT task, group_id, target, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT max(n) AS best, sum(n) AS n FROM c GROUP BY task, group_id) SELECT sum(n)::BIGINT AS rows, round(sum(best) / sum(n), 6) AS ceiling FROM m",
)
def ceiling(spark, sf_dir):
    return _rounded(M.ablation_ceiling(predictions(spark, sf_dir, "base"), ["task", "group_id"], "target"), "ceiling")


@query(
    "log_loss_spread",
    _P + "SELECT group_id, count(*) AS n, round(avg(log_loss), 6) AS mean, round(coalesce(stddev_samp(log_loss), 0), 6) AS sd, round(min(log_loss), 6) AS low, round(max(log_loss), 6) AS high FROM b GROUP BY 1",
)
def loss_spread(spark, sf_dir):
    return _rounded(M.spread(predictions(spark, sf_dir, "base"), "log_loss", "group_id"), "mean", "sd", "low", "high")


@query(
    "release_gates",
    _P + """, x AS (SELECT task, avg(accuracy) AS a, -avg(brier) AS q FROM t GROUP BY 1), y AS (SELECT task, avg(accuracy) AS a, -avg(brier) AS q FROM b GROUP BY 1)
    SELECT task, x.a >= y.a - 0.01 AS accuracy_passes, x.q >= y.q - 0.005 AS quality_passes FROM x JOIN y USING (task)""",
)
def release_gates(spark, sf_dir):
    tables = [
        M.means(predictions(spark, sf_dir, m), "task").select("task", "accuracy", (-F.col("brier")).alias("quality")) for m in ("trained", "base")
    ]
    return M.gates(*tables, "task", {"accuracy": 0.01, "quality": 0.005})


@query(
    "cluster_bootstrap",
    _P + """, v AS (SELECT b.group_id, t.accuracy - b.accuracy AS d FROM b JOIN t USING (id)),
    g AS (SELECT group_id, sum(d) AS s, count(*) AS n, row_number() OVER (ORDER BY group_id) - 1 AS k FROM v GROUP BY 1),
    c AS (SELECT count(*) AS groups, sum(s) AS s, sum(n) AS n FROM g),
    w AS (SELECT r, ('0x' || substr(sha256('41:' || r || ':' || d), 1, 8))::UBIGINT % groups AS k FROM c, range(0, 200) a(r), range(0, groups) q(d)),
    e AS (SELECT r, sum(s) / sum(n) AS e FROM w JOIN g USING (k) GROUP BY r)
    SELECT round(any_value(c.s / c.n), 6) AS difference, round(quantile_cont(e, 0.025), 6) AS lower_95, round(quantile_cont(e, 0.975), 6) AS upper_95,
           any_value(c.n)::BIGINT AS rows, any_value(groups) AS groups FROM e, c""",
)
def bootstrap(spark, sf_dir):
    both = M.paired(predictions(spark, sf_dir, "base"), predictions(spark, sf_dir, "trained"))
    values = both.select("group_id", (F.col("accuracy_t") - F.col("accuracy_b")).alias("d"))
    return _rounded(M.cluster_bootstrap(values, "group_id", "d", 200), "difference", "lower_95", "upper_95")


@query("length_histogram", "SELECT (n_chars // 128) * 128 AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy((F.floor(F.col("n_chars") / 128) * 128).alias("bucket")).agg(F.count("*").alias("n"))
