"""Operators on small frames, against brute force or values worked out by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import records as R
from millrace.functions import text as T
from millrace.functions.text import coded, normalize_lines, shingled, word_shingles
from millrace.operators import ordered, partition, rules
from millrace.operators.components import connected_components
from millrace.operators.dedup import dedup_decisions
from millrace.operators.similarity import minhash_signature, shingle_classes, similar_classes, text_signatures


def test_normalize_lines(spark):
    row = spark.createDataFrame([("  a \t\r\nb\rc  ",), (None,)], "t string").select(normalize_lines(F.col("t"))).collect()
    assert [r[0] for r in row] == ["  a\nb\nc", None]


def test_shingles_short_and_null(spark):
    rows = spark.createDataFrame([("A b",), ("A b C a b c",), (None,), ("",)], "t string").select(word_shingles(F.col("t"))).collect()
    assert [r[0] for r in rows] == [[], ["a b c", "b c a", "c a b"], [], []]


def test_shingles_and_signatures_of_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, "\u00dcn\u00ef_1-x ZWEI\u00a03, \u4e8c"), (2, None), (3, "a b"), (4, long), (5, "x x x x")], "id long, t string")
    shingles = word_shingles(F.col("t"))
    got = {r.id: r.s for r in docs.select("id", shingles.alias("s")).collect()}
    assert got[1] == ["\u00fcn\u00ef_1 x zwei", "x zwei 3", "zwei 3 \u4e8c"] and got[2] == got[3] == [] and got[5] == ["x x x"]
    assert len(got[4]) == 19_998
    signed = docs.select("id", minhash_signature(shingles, 2).alias("s")).where("s is not null")
    assert {r.id for r in signed.collect()} == {1, 4, 5}
    assert docs.limit(0).select(minhash_signature(shingles, 2)).collect() == []


def test_signature_is_the_salted_minimum(spark):
    got = spark.createDataFrame([("one two three four",)], "t string").select(minhash_signature(word_shingles(F.col("t")), 3, 5)).first()[0]
    items = [json.dumps(x).encode() for x in (["one", "two", "three"], ["two", "three", "four"])]
    assert got == [min(hashlib.sha256(f"minhash-v1:5:{i}:".encode() + x).hexdigest()[:16] for x in items) for i in range(3)]


def test_dedup_reasons_with_nulls(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a "), (3, "a"), (4, None), (5, ""), (6, "b")], "doc_id long, text string")
    got = {r.source_id: (r.retained_id, r.reason) for r in dedup_decisions(docs).collect()}
    assert got[1] == (1, "retained") and got[2] == (1, "normalized_match") and got[3] == (1, "exact_match")
    assert got[5] == (4, "exact_match") and got[6] == (6, "retained")
    assert dedup_decisions(docs.limit(0)).count() == 0


def test_similarity_join_is_exact(spark):
    r = random.Random(5)
    base = [r.choice("abcdefghij") for _ in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(r.randint(0, 8)):
            words[r.randrange(60)] = r.choice("klmnop")
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, classes = shingle_classes(docs)
    got = {(x.left_id, x.right_id) for x in similar_classes(classes, 70).collect()}
    sets = {x.rep: set(x.shingles) for x in classes.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    assert got == want and want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_group_quota_goes_on_after_a_skip(spark):
    groups = spark.createDataFrame([("t", str(i), n) for i, n in enumerate([5, 9, 3, 4, 1])], "task string, g string, n long")
    got = {r.g: r.taken for r in partition.group_quota(groups, "task", "g", "n", 10).collect()}
    used, want = 0, {}
    for g, n in sorted([(str(i), n) for i, n in enumerate([5, 9, 3, 4, 1])], key=lambda x: hashlib.sha256(x[0].encode()).hexdigest()):
        want[g] = used + n <= 10
        used += n if want[g] else 0
    assert got == want


def test_quotas_stream_through_groups(spark):
    r = random.Random(4)
    groups = [(r.choice(["s", "t", None]), str(i), r.randrange(1, 9)) for i in range(500)]
    got = partition.group_quota(spark.createDataFrame(groups, "task string, g string, n long"), "task", "g", "n", 100)
    used, want = {}, {}
    for t, g, n in sorted(groups, key=lambda x: hashlib.sha256(x[1].encode()).hexdigest()):
        want[g] = used.get(t, 0) + n <= 100
        used[t] = used.get(t, 0) + n * want[g]
    assert {x.g: x.taken for x in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_conflicts_drop_whole_groups(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("b", 4, "y")], "k string, id long, target string")
    assert [(r.id, r.copies) for r in partition.resolve_conflicts(rows, ["k"], "target", "id").collect()] == [(1, 2)]


def test_ledger_rejects_whole_operations(spark):
    events = [(1, i, a, q) for i, (a, q) in enumerate([("receive", 5), ("reserve", 4), ("ship", 2), ("release", 9), ("release", 1), ("ship", 2)])]
    got = ordered.ledger(spark.createDataFrame(events, "k int, i int, a string, q long"), "k", ["i"], "a", "q").first()
    assert (got.stock, got.reserved, got.available, got.rejected) == (3, 3, 0, 2)


def test_one_users_events_never_meet_in_one_array(spark):
    r = random.Random(3)
    users = [None, 7, *[1] * 8]
    events = [(r.choice(users), i, r.choice(["receive", "ship", "reserve", "release", "none"]), r.randrange(9)) for i in range(4000)]
    frame = spark.createDataFrame(r.sample(events, len(events)), "k int, i int, a string, q long")
    moves = {("s", "receive"): "t", ("t", "ship"): "u", ("u", "none"): "s", ("t", "none"): "s", ("u", "reserve"): "t"}
    want, states = {}, {}
    for k, _, a, q in events:
        stock, held, bad = want.get(k, (5, 0, 0))
        fits = q <= stock - held if a in ("ship", "reserve") else q <= held if a == "release" else True
        stock += fits * q * ((a == "receive") - (a == "ship"))
        held += fits * q * ((a == "reserve") - (a == "release"))
        want[k] = stock, held, bad + (not fits)
        states[k] = moves.get((states.get(k, "s"), a), states.get(k, "s"))
    got = ordered.ledger(frame, "k", ["i"], "a", "q", 5)
    assert {x.k: (x.stock, x.reserved, x.rejected) for x in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()
    machine = ordered.state_machine(frame, "k", ["i"], "a", "s", moves)
    assert {x.k: x.state for x in machine.collect()} == states
    assert "RepartitionByExpression [k#" in machine._jdf.queryExecution().toString()
    assert ordered.ledger(frame.limit(0), "k", ["i"], "a", "q").count() == ordered.state_machine(frame.limit(0), "k", ["i"], "a", "s", moves).count() == 0


def test_advantages(spark):
    steps = [(1, i, r, v) for i, (r, v) in enumerate([(1.0, 0.5), (0.0, 0.2), (2.0, 1.0)])]
    got = {r.i: r.advantage for r in ordered.discounted_advantages(spark.createDataFrame(steps, "k int, i int, r double, v double"), "k", "i", "r", "v", 0.9, 0.8).collect()}
    adv, nxt, want = 0.0, 0.0, {}
    for _, i, r, v in reversed(steps):
        adv = r + 0.9 * nxt - v + 0.72 * adv
        nxt, want[i] = v, adv
    assert got == pytest.approx(want)


def test_closure_and_truth(spark):
    facts = spark.createDataFrame([(1, "a"), (1, "not d")], "object long, fact string")
    given = spark.createDataFrame([(1, ["a"], "b"), (2, ["a", "b"], "c"), (3, ["c"], "d"), (4, ["e"], "f")], "rule int, needs array<string>, then string")
    assert {r.fact for r in rules.closure(facts, given).collect()} == {"a", "b", "c", "d", "not d"}
    states = spark.range(1).select(*[rules.truth(F.lit(p), F.lit(n)) for p, n in ((True, False), (False, True), (None, None), (True, True))]).first()
    assert tuple(states) == (rules.TRUTH[0], rules.TRUTH[1], rules.TRUTH[2], rules.TRUTH[3])


def test_half_open_intervals(spark):
    wanted = spark.createDataFrame([(1, 0, 5), (1, 5, 10), (1, 9, 12)], "key int, start long, stop long")
    taken = spark.createDataFrame([(1, 5, 9)], "key int, begin long, finish long")
    assert {(r.start, r.stop) for r in rules.free_candidates(wanted, taken, 4).collect()} == {(0, 5), (9, 12)}


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    letters = F.array(*map(F.lit, "abcd"))
    assert get(R.rotated(letters, F.lit(1))) == list("bcda")
    assert sorted(get(R.hash_ordered(letters, F.lit("s")))) == list("abcd")
    assert not get(R.valid_menu(F.array(F.lit("a"), F.lit("a"))))
    assert get(R.valid_distribution(F.array(F.lit(0.25), F.lit(0.75)))) and not get(R.valid_distribution(F.array(F.lit(0.5))))
    assert get(R.canonical_label(F.lit(" Yes.. "))) == "yes"
    assert get(R.command_template(F.lit("cp 'a b' 12.5 x"))) == "cp S N x"
    assert get(R.days_back(F.lit("the last 12 days"))) == 12 and get(R.days_back(F.lit("Yesterday"))) == 1
    boards = {tuple(get(R.canonical_board(F.array(*map(F.lit, b)), 2))) for b in ([1, 2, 3, 4], [3, 1, 4, 2], [2, 1, 4, 3])}
    assert len(boards) == 1


@pytest.mark.parametrize("seed", range(3))
def test_queued_responses_against_a_queue(spark, seed):
    from millrace.operators.schedules import queue_pairs

    r = random.Random(seed)
    rows = [(i % 2, r.choice("ab"), i, r.choice(["call", "reply", "other"])) for i in range(120)]
    waiting, want = {}, set()
    for k, name, i, kind in rows:
        if kind == "call":
            waiting.setdefault((k, name), []).append(i)
        elif kind == "reply" and waiting.get((k, name)):
            want.add((waiting[k, name].pop(0), i))
    got = queue_pairs(spark.createDataFrame(rows, "k int, name string, i int, kind string"), ["k", "name"], ["i"], "kind", "call", "reply").collect()
    calls = {(x.k, x.name, x.number): x.i for x in got if x.kind == "call"}
    assert {(calls[x.k, x.name, x.number], x.i) for x in got if x.kind == "reply" and x.matched} == want and want
    assert {x.i for x in got if x.kind == "call" and x.matched} == {a for a, _ in want}
    assert {x.number for x in got if not x.matched and x.kind == "reply"} <= {None}


@pytest.mark.parametrize("cap", [1, 2])
def test_capped_greedy_against_visits(spark, cap):
    from millrace.operators.schedules import capped_greedy

    r = random.Random(cap)
    rows = [(i, x) for i, x in enumerate(r.sample(range(1000), 60))]
    members = [(i, r.choice("abcdefghijkl")) for i in range(58) for _ in range(r.randint(1, 3))]  # some repeated, two rows in none
    held, want = {}, {}
    for i, _ in sorted(rows, key=lambda x: x[1]):
        own = {g for j, g in members if j == i}
        want[i] = all(held.get(g, 0) < (3 if g == "a" else cap) for g in own)
        for g in own:
            held[g] = held.get(g, 0) + want[i]
    caps = spark.createDataFrame([("a", 3)], "group string, cap int")
    frames = spark.createDataFrame(rows, "id int, rank int"), spark.createDataFrame(members, "id int, group string")
    for first in (5, 1000):  # several stretches, and one
        assert {x.id: x.taken for x in capped_greedy(*frames, cap, caps, first).collect()} == want
    assert capped_greedy(*[f.limit(0) for f in frames], cap).count() == 0


def test_capped_greedy_of_chains_stars_and_missing_groups(spark):
    from millrace.operators.schedules import capped_greedy

    chain = spark.createDataFrame([(i, i) for i in range(8)], "id int, rank int")
    pairs = spark.createDataFrame([(i, g) for i in range(8) for g in (i, i + 1)], "id int, group int")
    assert {x.id for x in capped_greedy(chain, pairs, 1, first=3).collect() if x.taken} == {0, 2, 4, 6}
    star = spark.createDataFrame([(i, 0) for i in range(7)] + [(7, None)], "id int, group int")  # a row in no group is taken
    assert {x.id for x in capped_greedy(chain, star, 3, first=2).collect() if x.taken} == {0, 1, 2, 7}
    assert {x.id for x in capped_greedy(chain, star, 0).collect() if x.taken} == {7}


def test_capped_greedy_keeps_few_links(spark, monkeypatch):
    from millrace.operators import schedules

    r = random.Random(5)
    rows = [(i, x) for i, x in enumerate(r.sample(range(10_000), 2000))]
    members = [(i, g) for i in range(2000) for g in (f"r{r.randrange(200)}", f"s{r.randrange(10)}")]
    groups, held, want = {}, {}, {}
    for i, g in members:
        groups.setdefault(i, set()).add(g)
    for i, _ in sorted(rows, key=lambda x: x[1]):
        want[i] = all(held.get(g, 0) < (1 if g[0] == "r" else 4) for g in groups[i])
        for g in groups[i]:
            held[g] = held.get(g, 0) + want[i]
    kept, cut = [], schedules.cut
    monkeypatch.setattr(schedules, "cut", lambda df, *n: kept.append(cut(df, *n)) or kept[-1])
    frames = spark.createDataFrame(rows, "id int, rank int"), spark.createDataFrame(members, "id int, group string")
    cap = F.when(F.col("group").startswith("r"), 1).otherwise(4)
    assert {x.id: x.taken for x in schedules.capped_greedy(*frames, cap, first=40).collect()} == want
    assert sum(x.count() for x in kept) < len(set(members))  # filled groups' links are not written, nor passed on


def test_permissions_of_repeats_and_nulls(spark):
    policies = [("a", "x", "allow"), ("a", "x", "allow"), ("b", "x", "deny"), ("b", "y", None), ("c", "y", "allow"), (None, "z", "allow")]
    roles = [("u", "a"), ("u", "a"), ("v", "a"), ("v", "b"), ("w", "b"), ("w", "c"), ("n", None)]
    frames = spark.createDataFrame(policies, "role string, resource string, effect string"), spark.createDataFrame(roles, "user string, role string")
    assert {tuple(x) for x in rules.permitted(*frames).collect()} == {("u", "x"), ("w", "y")}
    assert rules.permitted(*[f.limit(0) for f in frames]).count() == 0


def test_bootstraps_of_nulls_and_nothing(spark):
    from millrace.operators.metrics import cluster_bootstrap
    from millrace.operators.schedules import macro_bootstrap

    rows = spark.createDataFrame([(f, g, "t", 2.0) for f in ("a", None) for g in (1, 2, None)] + [("a", 1, "t", None)], "f string, g int, t string, v double")
    same = macro_bootstrap(rows, "f", "g", "t", "v", 20, "s").first()
    assert tuple(same) == (2.0, 2.0, 2.0, 6, 20)
    assert tuple(cluster_bootstrap(rows, "g", "v", 20).first()) == (2.0, 2.0, 2.0, 6, 3)
    assert tuple(cluster_bootstrap(rows.limit(0), "g", "v", 20).first()) == (None, None, None, 0, 0)
    assert macro_bootstrap(rows.limit(0), "f", "g", "t", "v", 20, "s").count() == 0


def test_shingles_leave_python_by_pieces(spark):
    import tracemalloc

    import pyarrow as pa

    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, None, "a"), (2, long, "b"), (3, "a b", None), (4, "A b c d", "c"), (None, long + " x", "c")], "id long, t string, o string")
    want = {(r.id, r.o): r.s for r in docs.select("id", "o", word_shingles(F.col("t"), 2).alias("s")).collect()}
    assert {(r.id, r.o): r.shingles for r in shingled(docs, "t", 2).collect()} == want and len(want[None, "c"]) == 60_000
    texts = pa.array([f"{i} {long[:20_000]}" for i in range(200)])
    tracemalloc.start()
    T._by_piece(texts, lambda x: T._shingles(x, 8), pa.list_(pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # 4 MB; 66 MB where the shingles of all texts exist at once


def test_sets_are_not_written_and_only_paired_classes_are_signed(spark, tmp_path, monkeypatch):
    from millrace.operators import similarity
    from millrace.plans import similarity_queries

    kept = []
    note = lambda df, *rows: kept.append(cut(df, *rows)) or kept[-1]
    cut = similarity.cut
    monkeypatch.setattr(similarity, "cut", note)
    monkeypatch.setattr(similarity_queries, "cut", note)
    base = [f"w{i}" for i in range(40)]
    texts = [base, base[:-1] + ["other"], [f"v{i}" for i in range(40)], base, [f"u{i}" for i in range(30)] + base[:9]]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = similarity_queries.estimates(spark, str(tmp_path)).collect()
    assert [(x.left_id, x.right_id) for x in got] == [(0, 1)]
    assert all("shingles" not in x.columns for x in kept)
    assert sorted(r.rep for x in kept if x.columns == ["rep", "s"] for r in x.collect()) == [0, 1]


def test_bootstrap_draws_are_spread_over_all_cores(spark, monkeypatch):
    from millrace.operators import schedules

    spread = []
    monkeypatch.setattr(schedules, "TASK_DRAWS", 500)
    repartition = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, n, *c: spread.append((n, *c)) or repartition(df, n, *c))
    rows = spark.createDataFrame([("all", g, "t", float(g % 2)) for g in range(100)], "f string, g long, t string, v double")
    got = schedules.macro_bootstrap(rows, "f", "g", "t", "v", 50, "seed").first()
    assert (got.groups, got.drawn, got.difference) == (100, 50, 0.5)
    assert (10, "f", "k") in spread


def test_codes_are_those_of_shingles(spark):
    texts = ["", None, "a b", "A b c a B c", "x é A b C", "Ünï İst ﬁn x_y 1²3 a b c d a b c", "\U0001f600 a\U00010400b c d 漢字 かな x", "w " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    codes = {x.id: x.codes for x in coded(docs, "t").collect()}
    sets = {x.id: x.s for x in docs.select("id", word_shingles(F.col("t")).alias("s")).collect()}
    of = {}
    for i, s in sets.items():
        assert len(s) == len(codes.get(i, []))
        for one in s:  # a shingle alone has the code that it has within a text
            of[one] = coded(docs.limit(1).select("id", F.lit(one).alias("t")), "t").first().codes[0]
    assert len(set(of.values())) == len(of)
    assert {i: {of[x] for x in s} for i, s in sets.items() if s} == {i: set(c) for i, c in codes.items()}
    signed = {x.id: x.signature for x in text_signatures(docs, "t", 2).collect()}
    assert signed == {x.id: x.s for x in docs.select("id", minhash_signature(word_shingles(F.col("t")), 2).alias("s")).collect()}
    _, classes = shingle_classes(docs, "id", "t")
    assert dict(classes.dtypes) == {"rep": "int", "shingles": "array<bigint>", "n": "int"}  # no strings leave Python
