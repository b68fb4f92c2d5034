"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import registry
from millrace.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(None if r[i] is None else cell(r[i]) for i in order) for r in rows) if rows and None not in {x for r in rows for x in r} else sorted(
        (tuple("~" if r[i] is None else cell(r[i]) for i in order) for r in rows)
    )


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    wanted = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, wanted.fetchall())


def test_whole_graphs_against_brute_force(spark, duck):
    edges, nodes = {}, range(1, 6)
    for k, a in duck.execute("SELECT p_partkey, p_size FROM part").fetchall():
        pair = a, k * 7 % 50 + 1
        edges[pair] = min(edges.get(pair, 99), k % 20 + 1)
    want = {}
    for start in nodes:
        cost, changed = {start: 0}, True
        while changed:
            offers = [(b, cost[a] + c) for (a, b), c in edges.items() if a in cost]
            changed = [(b, c) for b, c in offers if c < cost.get(b, math.inf)]
            for b, c in changed:
                cost[b] = min(c, cost.get(b, math.inf))
        want |= {(start, b): c for b, c in cost.items()}
    assert {(r.start, r.node): r.cost for r in registry.QUERIES["route_costs"](spark, SF).collect()} == want
    assert {(r.start, r.node) for r in registry.QUERIES["reachable_nodes"](spark, SF).collect()} == set(want)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, p in duck.execute("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem").fetchall():
        low, high = sorted((find((0, s)), find((1, p))))
        root[high] = low
    got = {r.node: r.component for r in registry.QUERIES["supplier_components"](spark, SF).collect()}
    assert got == {x[1]: find(x)[1] for x in list(root) if x[0] == 0}


def test_texts_and_vectors_are_read_whole(spark, tmp_path):
    same = "run the job with forty equal characters in front of "
    spark.createDataFrame([(f"{same}a 1",), (f"{same}b 2",), (f"{same}b 37",), (None,)], "text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.t: r.n for r in registry.QUERIES["command_templates"](spark, str(tmp_path)).collect()}
    assert got == {f"{same}a N": 1, f"{same}b N": 2, None: 1}
    spark.createDataFrame([(1, [0.0] * 8), (2, [0.0] * 7 + [math.log(9)])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (r.entropy, r.from_uniform) for r in registry.QUERIES["distribution_scores"](spark, str(tmp_path)).collect()}
    assert got[1] == pytest.approx((math.log(8), 0), abs=1e-6)
    assert got[2] == pytest.approx((7 / 16 * math.log(16) - 9 / 16 * math.log(9 / 16), 7 / 16), abs=1e-6)


def test_ownership_against_plain_rounds(spark, duck):
    fetch = lambda sql: duck.execute(sql).fetchall()
    records = fetch("SELECT DISTINCT l_orderkey, o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    aliases = fetch("SELECT DISTINCT l_suppkey, l_partkey * 1000 + l_suppkey % 7 FROM lineitem")
    rank = dict(fetch("SELECT s_suppkey, s_nationkey % 3 FROM supplier"))
    blocked = {}
    while True:
        meet = {}
        for s, a in aliases:
            if s not in blocked:
                meet.setdefault(("schema_alias", a), set()).add(s)
        servers = {}
        for r, q, s in records:
            servers.setdefault((r, q), set()).add(s)
        for (_, q), members in servers.items():
            if not members & set(blocked) and len({rank[s] for s in members}) == 1:
                meet.setdefault(("repeated_request", q), set()).update(members)
        new = {}
        for (reason, _), members in meet.items():
            for s in members:
                if rank[s] < max(rank[x] for x in members):
                    new[s] = min(reason, new.get(s, reason))
        if not new:
            break
        blocked |= new
    got = {r.server: r.reason for r in registry.QUERIES["owned_servers"](spark, SF).collect()}
    assert got == blocked and blocked


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.reason for r in e.entry(spark).collect()} >= {"retained"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_first_come_documents_against_visits(spark, tmp_path):
    import random

    r = random.Random(3)
    base = [[r.choice("abcdefghijklmnop") for _ in range(40)] for _ in range(4)]
    texts = []
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(r.randint(0, 5)):
            words[r.randrange(40)] = r.choice("qrstuv")
        texts.append(" ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets, kept = [set(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)], []
    first = [i for i, s in enumerate(sets) if s not in sets[:i]]
    for i in first:
        if not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in kept):
            kept.append(i)
    got = {x.id: x.taken for x in registry.QUERIES["first_come_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: i in kept for i in first} and 4 < len(kept) < len(first)


def test_capped_selection_against_visits(spark, duck):
    import hashlib

    servers, held, want = {}, {}, {}
    for k, s in duck.execute("SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem").fetchall():
        servers.setdefault(k, set()).add(s)
    seen = set()
    for k, c in sorted(duck.execute("SELECT o_orderkey, o_custkey FROM orders").fetchall(), key=lambda x: hashlib.sha256(f"select:{x[0]}".encode()).hexdigest()):
        want[k] = c not in seen and all(held.get(s, 0) < 8 for s in servers.get(k, ()))
        if want[k]:
            seen.add(c)
            for s in servers.get(k, ()):
                held[s] = held.get(s, 0) + 1
    assert {x.id: x.taken for x in registry.QUERIES["capped_selection"](spark, SF).collect()} == want


def test_json_leaves_and_witnesses_on_odd_values(spark):
    from pyspark.sql import functions as F

    from millrace.functions import witness as W

    rows = [(1, '{"a":[1,{"b":"x"}],"c":{},"d":null}'), (2, None), (3, "{"), (4, "7"), (5, "[true,1.5]")]
    got = {tuple(x) for x in W.json_leaves(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect()}
    assert got == {(1, "$.a[0]", "1", "number"), (1, "$.a[1].b", "x", "string"), (1, "$.d", None, "null"), (4, "$", "7", "number"), (5, "$[0]", "true", "boolean"), (5, "$[1]", "1.5", "number")}
    pairs = [(6, -4), (0, 5), (-9, 3), (7, 0), (None, 2), (2**40, 2**20)]
    got = [None if x.q is None or x.q.num is None else tuple(x.q) for x in spark.createDataFrame(pairs, "a long, b long").select(W.reduced(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got == [(-3, 2), (0, 1), (-3, 1), None, None, (2**20, 1)]
    text = spark.createDataFrame([("owes $1,200.5 and $3", "1200.50"), ("1200.50", "1200.50"), (None, "1"), ("$4 $04", "4")], "t string, a string")
    assert [x[0] for x in text.select(W.amount_witness(F.col("t"), F.col("a").cast("decimal(20,2)"))).collect()] == ["$1,200.5", None, None, "$4"]
    assert spark.createDataFrame([("9:05",), ("00:10",), (None,)], "t string").select(W.shifted_times(F.col("t"), F.lit(20)).alias("x")).collect() == [(None,), (["23:50", "00:30"],), (None,)]


def test_throughput_of_close_events(spark, duck, tmp_path):
    duck.execute(
        f"""COPY (SELECT i AS event_id, 1 AS user_id, TIMESTAMP '2024-01-01 00:00:11.172425' + to_microseconds(i * i * 37 // 2) AS ts, round(i * 7.31 % 90, 2) AS value
        FROM range(0, 200) r(i)) TO '{tmp_path}/events.parquet'"""
    )
    wanted = duck.execute(registry.ORACLE_SQL["event_throughput"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(map(tuple, registry.QUERIES["event_throughput"](spark, str(tmp_path)).collect())) == sorted(wanted)


def test_state_differences_in_one_aggregation(spark, tmp_path):
    lines = [(1, 20.0, 0.1), (1, 5.0, 0.0), (2, 20.0, 0.0), (3, 5.0, 0.0), (3, None, 0.0), (4, 5.0, 0.1), (None, 20.0, 0.1), (None, 1.0, 0.0)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_tax double")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.QUERIES["state_differences"](spark, str(tmp_path))
    want = [(1, 1, "missing"), (1, 2, "extra"), (3, 2, "extra"), (None, 1, "missing"), (None, 2, "extra")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got._jdf.queryExecution().sparkPlan().toString().count("Scan parquet") <= 1  # each state was counted twice
