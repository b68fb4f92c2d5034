"""The training-data operators against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import math
import os
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from edge_rows import BOILER, EDGE, PASSAGE, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, exact_dedup, fingerprint, langid, line_templates, mixing, near_dedup, pii, queries, sentence_spans, warc
from millrace.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def reference_encoder():
    encoder = Tokenizer.from_file(TOKENIZER)
    encoder.no_padding()
    encoder.no_truncation()
    return encoder


def components(texts, size, percent=80):
    """doc_id -> smallest linked id, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * (c := len(x & y)) >= percent * (len(x) + len(y) - c):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("name", sorted(k for k, v in queries.ORACLE_SQL.items() if v))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in wanted.description)
    at = [[d[0] for d in wanted.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())


def test_every_operator_has_a_query():
    assert {n for k in queries.QUERIES for n in re.findall(r"^op(\d+)_", k)} == {str(n) for n in range(1, 14)}
    assert "pipeline" in queries.QUERIES


# 1 -------------------------------------------------------------------------------------------------------------


def test_fingerprints_of_edited_texts(docs):
    got = by_id(fingerprint.compare_with_next(docs))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    prints = dict(zip(order, fingerprint.as_text(fingerprint.fingerprints([texts[i] for i in order])), strict=True))
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % len(order)]]
        cut = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - cut] + after[:cut]
        assert got[i].n_chars == len(texts[i])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == prints[i]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = defaultdict(set)
    for i, t in texts.items():
        same[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.35 > np.mean([r.near_next for r in long])


def test_parsing_is_locally_consistent():
    inner = " ".join(f"phrase number {i} of the shared passage" for i in range(120))
    a, b = fingerprint.fingerprints(["some words before it " + inner, "quite other, longer words come before " + inner])
    assert fingerprint.likeness(a[None], b[None])[0] > 0.8


def plain_fingerprint(text):
    """The fingerprint of a text, parsed symbol by symbol."""
    mix = lambda x: int(fingerprint._mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    odd = [int(x) for x in fingerprint._ODD]
    names, level, wide, tiers = [ord(c) + 1 for c in text], 0, False, [[], [], []]
    while names:
        tiers[min(level, 2)] += [mix(x) for x in names]
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = []
        for x, n in runs:
            run = mix(x + n * odd[3])
            names.append(x if n == 1 else run if wide else (run & 0x7FFFFFFF) + 0x110001)
        if len(names) == 1:
            break
        labels = []
        for i, x in enumerate(names):
            d = x ^ names[i - 1] if i else x
            low = (d & -d).bit_length() - 1
            labels.append(2 * low + (x >> low & 1))
        for _ in range(3):
            labels = [int(fingerprint._TOSS[labels[i - 1] if i else 0, x]) for i, x in enumerate(labels)]
        tops = [i for i in range(2, len(names) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
        cuts = [0, *tops, len(names)]
        phrases = [names[a:b] for a, b in zip(cuts, cuts[1:])]
        names = [mix(sum(x * odd[k & 63] for k, x in enumerate(p)) + len(p)) for p in phrases]
        wide, level = True, level + 1
    out, before = [], 0
    for (classes, _), found in zip(fingerprint.TIERS, tiers):
        least, seen = {}, Counter()
        for x in found:
            y = mix(x + seen[x] * odd[11])
            seen[x] += 1
            place = (y >> 40) * classes >> 24
            least[place] = min(least.get(place, 2**64), y & (2**40 - 1))
        out += [mix(least[k]) % fingerprint.NO_NAME if k in least else fingerprint.NO_NAME for k in range(classes)]
    return "".join(f"{x:04x}" for x in out)


def test_fingerprints_equal_a_plain_parsers(docs, edge):
    texts = [r.text or "" for r in docs.limit(60).collect()] + [r.text or "" for r in edge.collect() if len(r.text or "") < 5000]
    texts = [t[:4000] for t in texts] + ["aaaa", "aaaabbbbaaaa" * 9, "x" * 300, "ab" * 100]
    assert fingerprint.as_text(fingerprint.fingerprints(texts)) == [plain_fingerprint(t) for t in texts]


def test_likeness_has_no_steps(docs):
    texts = [r.text for r in docs.collect() if len(r.text or "") > 130]
    near = []
    for n in range(20, 121):
        a, b = (fingerprint.fingerprints([t[:k] for t in texts]) for k in (n, n + 1))
        near.append(fingerprint.likeness(a, b).mean())
    assert max(abs(x - y) for x, y in zip(near, near[1:])) < 0.06 and min(near) > 0.45


def test_fingerprint_edges(spark, edge, empty):
    assert fingerprint.compare_with_next(empty).count() == 0
    got = fingerprint.compare_with_next(edge).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in EDGE)
    one = fingerprint.compare_with_next(rows(spark, [(1, "only one text", "en", "web")])).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 13)]


# 2 -------------------------------------------------------------------------------------------------------------


def targets(sizes):
    """Water filling source by source: name -> target."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else share[s] for s in names}
        full |= over


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_mix_meets_its_targets(request, which):
    table = request.getfixturevalue(which)
    got = mixing.mix(table).collect()
    sizes, taken, given = Counter(), Counter(), {}
    for r in table.select("source", "text").collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    wanted = targets(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == sum(p.words for p in r.pieces) <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        given[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in given.items())
    assert len(got) == table.count()
    key = lambda x: sorted((str(r.doc_id), r.size, r.taken) for r in x)
    assert key(got) == key(mixing.mix(table.repartition(7)).collect())


def test_draws_are_placed_once(docs):
    """No word is taken twice in a pass, and the shards differ in size by the last block at most."""
    shards, seen = Counter(), set()
    for r in mixing.mix(docs, shards=4, block_words=64).collect():
        for p in r.pieces:
            shards[p.shard] += p.words
            words = {(r.doc_id, p.turn, w) for w in range(p.first, p.first + p.words)}
            assert not words & seen
            seen |= words
    assert set(shards) <= set(range(4)) and min(shards.values()) > 0.9 * max(shards.values())


def test_leaves_quotas_are_what_the_shards_draw(spark):
    quotas = {0: 7000, 1: 41, 2: 900, 3: 0}
    tree = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "rank int, draws long"), 8)
    left = {r.rank: r.left for r in tree.collect()}
    nodes = {1: dict(quotas)}
    for node in range(1, 8):
        nodes[2 * node] = {k: left[k][node - 1] for k in quotas}
        nodes[2 * node + 1] = {k: nodes[node][k] - left[k][node - 1] for k in quotas}
        assert all(0 <= left[k][node - 1] <= nodes[node][k] for k in quotas)
        assert abs(sum(nodes[2 * node].values()) - sum(nodes[2 * node + 1].values())) <= 1
    assert all(sum(nodes[n][k] for n in range(8, 16)) == q for k, q in quotas.items())


def test_another_tree_deals_the_same_blocks_otherwise(docs):
    four, eight = (mixing.mix(docs, shards=n, block_words=64).collect() for n in (4, 8))
    assert {(r.doc_id, r.taken) for r in four} == {(r.doc_id, r.taken) for r in eight}
    where = [{(r.source, p.place): p.shard for r in x for p in r.pieces} for x in (four, eight)]
    assert where[0].keys() == where[1].keys() and where[0] != where[1]
    # a shard's draws of a source are a range of the source's draws, as long as its leaf's quota
    sizes = Counter((s, shard) for (s, _), shard in where[0].items())
    draws = Counter(s for s, _ in where[0])
    ranks = {s: i for i, s in enumerate(sorted(draws, key=lambda s: (s is None, s)))}
    spark = docs.sparkSession
    tree = mixing.splitting_tree(spark.createDataFrame([(ranks[s], n) for s, n in draws.items()], "rank int, draws long"), 4)
    left = {r.rank: r.left for r in tree.collect()}
    for s, i in ranks.items():
        a, b, c = left[i]
        assert [sizes[s, k] for k in range(4)] == [b, a - b, c, draws[s] - a - c]


def test_blocks_are_permuted(spark):
    for blocks in (1, 2, 7, 256, 1000):
        at = spark.range(blocks).select(mixing._permuted(F.col("id"), F.lit(blocks), F.lit(3), F.lit("k")).alias("p")).collect()
        assert sorted(r.p for r in at) == list(range(blocks))
        assert blocks < 100 or sum(r.p == i for i, r in enumerate(at)) < 10


def test_hypergeometric_numbers(spark):
    """Mean and spread of the draws, a narrow and a wide one."""
    u = (F.col("id") + 0.5) / 400
    for total, good, drawn in ((50, 20, 10), (4_000_000, 1_000_000, 2_000_000)):
        row = spark.range(400).select(mixing.hypergeometric(*(F.lit(x).cast("long") for x in (total, good, drawn)), u).alias("x"))
        mean, sd = row.agg(F.mean("x"), F.stddev("x")).first()
        p = good / total
        spread = (drawn * p * (1 - p) * (total - drawn) / (total - 1)) ** 0.5
        assert mean == pytest.approx(drawn * p, abs=0.05 * spread) and sd == pytest.approx(spread, rel=0.05)


def test_written_mixture_holds_the_pieces(spark, docs, tmp_path):
    path = str(tmp_path / "mix")
    mixing.write_mixture(docs, path, shards=4)
    written = spark.read.parquet(path).select("doc_id", mixing.word_count(F.col("text")).alias("n")).groupBy("doc_id").sum("n")
    assert {r[0]: r[1] for r in written.collect()} == {r.doc_id: r.taken for r in mixing.mix(docs, shards=4).collect() if r.taken}


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(empty, shards=3)


# 3 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "edge", "empty"])
def test_ids_equal_the_librarys(request, reference_encoder, which):
    table = request.getfixturevalue(which)
    got = bpe.round_trip_digests(table, TOKENIZER).collect()
    wanted = []
    for r in table.select("doc_id", "text").collect():
        ids = reference_encoder.encode(r.text or "", add_special_tokens=False).ids
        text = reference_encoder.decode(ids, skip_special_tokens=False)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        wanted.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(text)))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, wanted))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab eé\n\t\xa0 'sll9,<|endoftext>　✨ "), max_size=60))
def test_codec_equals_the_library(text):
    codec = test_codec_equals_the_library.__dict__.setdefault("codec", bpe.Codec(open(TOKENIZER, encoding="utf-8").read()))
    library = test_codec_equals_the_library.__dict__.setdefault("library", Tokenizer.from_file(TOKENIZER))
    ids = codec.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_run_of_white_space(reference_encoder):
    codec = bpe.Codec(open(TOKENIZER, encoding="utf-8").read())
    space = " \xa0\n\t\r\u3000\u2009"
    runs = ["".join(x) for n in range(1, 6) for x in itertools.product(space, repeat=n)]
    for around in ("a{}b", "{}b", "a{}", "{}", "a{}1 b", "a {}b"):
        texts = [around.format(x) for x in runs]
        wanted = reference_encoder.encode_batch(texts, add_special_tokens=False)
        got = codec.encode_many(texts)
        assert [t for t, a, b in zip(texts, got, wanted, strict=True) if a.tolist() != b.ids] == []


def test_decoding_gives_the_texts_back(docs):
    encoded = bpe.encode_documents(docs, TOKENIZER)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, TOKENIZER).collect()} == {r.doc_id: r.text or "" for r in docs.collect()}


# 4 -------------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = by_id(langid.predict_languages(table))
    truth = {r.doc_id: r for r in table.collect()}
    judged = [i for i, r in got.items() if r.held_out and truth[i].lang is not None and r.lang_pred != "und" and len(truth[i].text) > 40]
    assert len(judged) > 100
    assert np.mean([got[i].lang_pred == truth[i].lang for i in judged]) > 0.95


def plain_grams(text):
    """All hashed n-grams of a text: runs of letters between single blanks, blanks alone left out."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    padded = [ord(c) for c in f" {' '.join(runs)} "] if runs else []
    out = []
    for n in langid.ORDERS:
        for at in range(len(padded) - n + 1):
            h = 0
            for k, c in enumerate(padded[at : at + n], 1):
                h = (h * 0x9E3779B97F4A7C15 + c + k) % 2**64
            if n > 1 or padded[at] != 32:
                out.append((h ^ h >> 29) * 0xD6E8FEB86659FD93 % 2**64 * langid.BUCKETS >> 64)
    return out


def plain_bayes(data):
    """[(lang_pred, score, doubt)] of (doc_id, text, lang) rows: naive Bayes a document at a time."""
    grams, n_docs = defaultdict(Counter), Counter()
    for i, text, lang in data:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang is not None:
            grams[lang].update(plain_grams(text))
            n_docs[lang] += 1
    total = {x: sum(grams[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in n_docs}
    prior = {x: math.log(n / sum(n_docs.values())) for x, n in n_docs.items()}
    for _, text, _ in data:
        seen = Counter(plain_grams(text))
        if not seen or not n_docs:
            yield "und", 0.0, 1.0
            continue
        evidence = {x: math.fsum(n * math.log((grams[x][g] + langid.SMOOTHING) / total[x]) for g, n in seen.items()) for x in n_docs}
        order = sorted(n_docs, key=lambda x: (-evidence[x] - prior[x], x))
        tempered = {x: evidence[x] * min(1, langid.SCORE_NGRAMS / seen.total()) + prior[x] for x in n_docs}
        top = max(tempered.values())
        share = {x: math.exp(v - top) for x, v in tempered.items()}
        doubt = evidence[order[0]] + prior[order[0]] - evidence[order[1]] - prior[order[1]] if len(order) > 1 else 1.0
        yield order[0], share[order[0]] / sum(share.values()), doubt


@pytest.mark.parametrize("which", ["docs", "edge", "empty"])
def test_languages_equal_a_plain_bayes(request, which):
    table = request.getfixturevalue(which)
    data = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    want, got = defaultdict(list), defaultdict(list)
    for (i, _, _), (lang, score, doubt) in zip(data, plain_bayes(data), strict=True):
        want[i].append((round(score, 7), lang if doubt > 1e-6 else "tie"))
    ties = {i for i, x in want.items() if any(lang == "tie" for _, lang in x)}
    assert len(ties) <= len(data) // 50
    for r in langid.predict_languages(table).collect():
        got[r.doc_id].append((r.score, r.lang_pred))
    assert set(got) == set(want)
    for i in set(want) - ties:
        a, b = sorted(got[i]), sorted(want[i])
        assert [x for _, x in a] == [x for _, x in b] and np.allclose([x for x, _ in a], [x for x, _ in b], atol=1e-6)


@given(st.lists(st.text(alphabet="aBß .\n1𝔘é", max_size=8), min_size=1, max_size=6))
@settings(deadline=None)
def test_ngrams_do_not_depend_on_other_texts(texts):
    got = [Counter() for _ in texts]
    for grams, counts in langid.features(texts):
        for x, part in zip(got, np.split(grams, np.cumsum(counts)[:-1]), strict=True):
            x.update(part.tolist())
    assert got == [Counter(plain_grams(x)) for x in texts]


def test_too_many_languages_are_refused(docs, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.predict_languages(docs)


def test_held_out_labels_are_not_used(docs):
    blind = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("en")).otherwise(F.col("lang")))
    assert by_id(langid.predict_languages(docs)) == by_id(langid.predict_languages(blind))


def test_language_edges(edge, empty):
    got = defaultdict(list)
    for r in langid.predict_languages(edge).collect():
        got[r.doc_id].append(r)
    assert len(got[None]) == 2 and len(got[8]) == 2
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (3, 4, 5, 9))
    assert all(0 <= r.score <= 1 for x in got.values() for r in x)
    assert langid.predict_languages(empty).count() == 0
    assert langid.keep_identified(edge).columns == edge.columns


# 5 -------------------------------------------------------------------------------------------------------------


def test_recurring_lines_go(edge, empty):
    got = line_templates.drop_recurring_lines(edge).collect()
    own = [r for r in got if r.doc_id is not None and r.doc_id >= 20]
    assert all(r.n_dropped >= 1 and BOILER.strip() not in r.text for r in own)
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in EDGE)
    assert {r.n_dropped for r in got if r.doc_id in (1, 3, 4, 6, 12)} == {0}
    assert line_templates.drop_recurring_lines(empty).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, 1 << 15])
def test_exact_copies(edge, max_bits):
    got = exact_dedup.exact_dedup(edge, max_bits=max_bits).collect()
    groups = defaultdict(list)
    for i, text, *_ in EDGE:
        groups[(text or "").translate(LOWER)].append(i)
    keys = {hashlib.sha256(t.encode()).hexdigest(): x for t, x in groups.items()}
    assert len(got) == len(EDGE)
    for r in got:
        members = keys[r.text_sha256]
        assert r.group_size == len(members) and r.keep_id == max((i for i in members if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_first_copies(edge, max_bits=max_bits).collect()
    assert Counter((r.text or "").translate(LOWER) for r in kept) == Counter(groups.keys())


def test_no_copies_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0 == exact_dedup.keep_first_copies(empty).count()


# 7 -------------------------------------------------------------------------------------------------------------


def test_archives_roll_and_are_readable_alone(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>{i % 40} " + "words of the page " * (i % 40 + 6)) for i in range(200)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(table.coalesce(1), str(tmp_path / "a"), block_bytes=300, blocks=3)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 4 and max(f.stat().st_size for f in files) < max(len(p[2]) for p in pages) * 3 + 70_000
    seen = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert {int(x.page_id): x.record_type for x in seen} == {i: "response" if i < 40 else "revisit" for i in range(200)}
    assert {int(x.page_id): x.refers_to for x in seen if x.record_type == "revisit"} == {i: str(i % 40) for i in range(40, 200)}
    alone = warc.read_archives(spark, str(files[-1])).collect()
    assert alone and all(x.html == pages[int(x.page_id)][2] for x in alone if x.record_type == "response")


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "payload " * 40 + "</p>"
    pages = [(5, "http://a/ä b", big), (3, None, big), (9, "http://c", None), (2, "http://d", ""), (7, "http://e", "<p>small</p>"), (8, "http://f", "<p>small</p>"), (None, "http://g", big), (4, "http://h", "\x28\xb5\x2f\xfd ünï " * 50), (1, "http://i", "P*M\x18\0\0\0\0" * 40)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archive_round_trip(table.withColumn("digest", F.lit("x")).withColumn("frame", F.lit(1)))
    rows_of = sorted(map(tuple, got.collect()), key=str)
    wanted = []
    for i, _, html in pages:
        payload = (html or "").encode()
        revisit = payload == big.encode() and i != 3
        wanted.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert rows_of == sorted(wanted, key=str)
    warc.write_archives(table, str(tmp_path / "a"))
    back = warc.read_archives(spark, str(tmp_path / "a"))
    assert {r.page_id: r.html for r in back.where("record_type = 'response' and page_id is not null").collect()} == {
        str(i): html or "" for i, _, html in pages if i is not None and i != 5
    }
    for name in os.listdir(tmp_path / "a"):
        if name.startswith("part-"):
            head = (tmp_path / "a" / name).read_bytes()[:4]
            assert int.from_bytes(head, "little") & 0xFFFFFFF0 == 0x184D2A50  # the dictionary leads
    assert warc.archive_round_trip(table.limit(0)).count() == 0
    assert zstandard.ZSTD_VERSION


# 8 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("shingle", "rounds"), [(2, 2), (5, 2), (2, 0)])
def test_near_copies_against_all_pairs(spark, docs, monkeypatch, shingle, rounds):
    """With no round of hubs, the prefix filter finds all links alone."""
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", rounds)
    base = [f"w{i}" for i in range(60)]
    edited = [[*base[:k], "new", *base[k + 2 :]] for k in range(0, 50, 3)] + [[*base[:k], "a", "b", "c", "d", *base[k + 9 :]] for k in range(0, 50, 5)]
    data = [(10_000 + i, " ".join(w), "en", "web") for i, w in enumerate([base, *edited])]
    table = docs.select("doc_id", "text").unionByName(rows(spark, data).select("doc_id", "text"))
    got = by_id(near_dedup.near_duplicates(table, shingle=shingle))
    wanted, sizes = components({r.doc_id: r.text for r in table.collect()}, shingle)
    assert {i: (r.component_id, r.n_shingles, r.kept) for i, r in got.items()} == {i: (c, sizes[i], c == i) for i, c in wanted.items()}


def test_near_copy_edges(edge, empty):
    got = near_dedup.near_duplicates(edge, shingle=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in EDGE)
    seen = {r.doc_id: r for r in got}
    assert seen[2].component_id == 1 and seen[7].component_id == 6
    assert all(seen[i].kept and seen[i].n_shingles == 0 for i in (3, 4, 5))
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_representatives(edge).columns == edge.columns


def test_sketches_merge():
    a, b = near_dedup.shingle_set("a b c d e f g h", 2), near_dedup.shingle_set("f g h i j k", 2)
    union = near_dedup.sketch(np.union1d(a, b))
    assert (np.maximum(near_dedup.sketch(a), near_dedup.sketch(b)) == union).all()


# 9 -------------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in string.digits]
            double = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(double) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet="a@.b-+ 0129()\n_é", max_size=60), st.from_regex(PLAIN["phone"]), st.text(alphabet="4 1-0", max_size=40)))
def test_fixed_formats(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_of_documents(docs, edge, empty):
    for table in (docs, edge):
        texts = defaultdict(list)
        for r in table.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text or "")
        got = pii.find_personal_data(table).collect()
        assert len(got) == table.count()
        for r in got:
            found = {pii.joined(x): x for x in map(plain_spans, texts[r.doc_id])}
            base = next(x for k, x in found.items() if hashlib.sha256(k.encode()).hexdigest() == r.base_sha256)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PLAIN]
            spans = r.spans.split(",") if r.spans else []
            keys = sum(x.startswith("secret:") for x in spans)
            assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans) and len(spans) == r.n_spans
            assert len(base) + r.added <= r.n_spans <= len(base) + r.added + keys
    assert pii.find_personal_data(empty).count() == 0


def test_contexts_discover_identifiers(spark):
    data = [(i, f"Please reach me by writing to user{i}@example.org today", "en", "web") for i in range(30)]
    data += [(100, "Please reach me by writing to hidden.person@intranet today", "en", "web"), (101, "the year 1984 was long", "en", "web")]
    got = by_id(pii.find_personal_data(rows(spark, data)))
    assert got[100].added == 1 and got[100].spans.startswith("email:30:") and got[100].n_email == 0
    assert got[101].spans == ""


def plain_bootstrap(found):
    """The rounds in plain Python: instance -> kind of those discovered, and the trusted patterns."""
    edges = {(p, o["instance"]) for o in found for p in o["patterns"]}
    of = defaultdict(set)
    for p, i in edges:
        of[p].add(i)
    shape, failed = ({o["instance"]: o[x] for o in found} for x in ("form", "failed"))
    seeds = {(o["instance"], o["kind"]) for o in found if o["kind"]}
    seeded, discovered, seen = {i for i, _ in seeds}, {}, []
    while True:
        labels = {**{x: 1.0 for x in seeds}, **{(i, k): s for i, (s, k) in discovered.items()}}
        known = {i for i, _ in labels}
        trusted = {}
        for p, members in of.items():
            for kind in pii.ALL_KINDS:
                held = [labels[i, kind] for i in members if (i, kind) in labels]
                forms = {shape[i] for i, k in labels if k == kind}
                free = [i for i in members if i not in known and shape[i] in forms and failed[i] != kind]
                share = sum(held) / (sum(held) + len(members) - len(held) - len(free) + pii.DOUBT) if held else 0
                if len(held) >= pii.MIN_SUPPORT and share >= pii.MIN_CONFIDENCE:
                    trusted[p, kind] = share
        doubt = defaultdict(lambda: 1.0)
        for (p, kind), share in trusted.items():
            for i in of[p] - seeded:
                if failed[i] != kind:
                    doubt[i, kind] *= 1 - share
        after = {}
        for (i, kind), d in doubt.items():
            after[i] = max(after.get(i, (0, "")), (round(1 - d, 12), kind))
        kinds = {i: k for i, (_, k) in after.items()}
        if not kinds or kinds in seen:
            return kinds, trusted
        seen.append(kinds)
        discovered = after


def test_rounds_against_plain_python(spark, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    key = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    made = [f'token = "{key[i:] + key[:i]}" is one' for i in range(6)] + [f"TOKEN = hidden-{i}-word, kept" for i in range(2)]
    made += [f"Des +1 (826) 555-{4000 + i} then" for i in range(5)] + ["Des +1 (826) 555-4081 190.137.2.44 both", "card no 4111111111111112 here"]
    made += [f"token = other-{key[:i]}9876 there" for i in range(1, 4)] + ["reach other-09876 at other-019876 now"]
    texts |= {10_000 + i: t for i, t in enumerate(made)}
    found = [o for t in texts.values() for o in pii.occurrences(t, pii.base_spans(t))]
    wanted, trusted = plain_bootstrap(found)
    assert "+1 (826) 555-4081" in wanted and "4111111111111112" not in wanted
    got = by_id(pii.find_personal_data(rows(spark, [(i, t, "en", "web") for i, t in texts.items()])))
    for i, t in texts.items():
        new = [o for o in pii.occurrences(t, pii.base_spans(t)) if o["kind"] is None and o["instance"] in wanted]
        spans = set(got[i].spans.split(","))
        assert got[i].added <= len(new) and (got[i].added > 0) == bool(new)
        told = {f"{wanted[o['instance']]}:{o['start']}:{o['end']}" for o in new}
        assert len(told & spans) == got[i].added
        assert all(any((p, wanted[o["instance"]]) in trusted for p in o["patterns"] ) or o["instance"] in wanted for o in new)
    assert sum(r.added for r in got.values()) > 0


# 10 ------------------------------------------------------------------------------------------------------------


def test_repeated_spans_against_all_runs(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    seen, covered = set(), defaultdict(set)
    for i in sorted(texts):
        found = sentence_spans.sentences(texts[i])
        plain = [" ".join(texts[i][a:b].lower().split()) for a, b, _ in found]
        for k in range(len(found)):
            stop = k
            while stop < len(found) and (stop - k < sentence_spans.MIN_SENTENCES or sum(f[2] for f in found[k:stop]) < sentence_spans.MIN_WORDS):
                stop += 1
            if stop - k >= sentence_spans.MIN_SENTENCES and sum(f[2] for f in found[k:stop]) >= sentence_spans.MIN_WORDS:
                if (run := tuple(plain[k:stop])) in seen:
                    covered[i] |= set(range(k, stop))
                seen.add(run)
    got = by_id(sentence_spans.drop_repeated_spans(docs))
    assert {i: r.n_removed for i, r in got.items()} == {i: len(covered[i]) for i in texts}
    for i, r in got.items():
        left = [texts[i][a:b].split() for k, (a, b, _) in enumerate(sentence_spans.sentences(texts[i])) if k not in covered[i]]
        assert r.text.split() == [w for x in left for w in x]
        assert r.removed_chars == len(texts[i]) - len(r.text) and (covered[i] or r.text == texts[i])


def test_passages_stay_once(edge, empty):
    got = {r.doc_id: r.text for r in sentence_spans.drop_repeated_spans(edge).collect()}
    first = PASSAGE.split(".")[0]
    assert first in got[10] and first not in got[11] and "Something else first" in got[11]
    assert sentence_spans.drop_repeated_spans(empty).count() == 0


def test_passages_go_wherever_they_stand(spark):
    r = random.Random(7)
    words = lambda n, ends: [f"w{r.randrange(5000)}" + "." * (r.random() < ends) for _ in range(n)]
    passages = [words(51, ends) for ends in (0, 0.05, 0.1, 0.2) for _ in range(25)]
    data = []
    for copy in range(2):
        for i, p in enumerate(passages):
            text = " ".join(words(r.randrange(1, 60), 0.05) + p + words(r.randrange(1, 60), 0.05))
            data.append((1000 * copy + i, text, "en", "web"))
    got = by_id(sentence_spans.drop_repeated_spans(rows(spark, data), back=True))
    for i, p in enumerate(passages):
        assert got[i].n_removed == 0
        assert len(got[1000 + i].text.split()) <= len(data[len(passages) + i][1].split()) - 26, " ".join(p)


def test_a_passage_goes_to_its_last_sentence(spark):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. Fifteen sixteen. Seventeen."
    data = [(1, f"First words here. {passage} Something else follows on.", "en", "web"), (2, f"Other start. {passage} Its own end.", "en", "web")]
    assert by_id(sentence_spans.drop_repeated_spans(rows(spark, data), back=True))[2].text == "Other start. Its own end."


# Pipeline ------------------------------------------------------------------------------------------------------


def test_stages_against_brute_force(spark, docs, reference_encoder, tmp_path):
    given, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, SF).write.parquet(str(tmp_path / name))
        given = spark.read.parquet(str(tmp_path / name))
        kept[name] = given.collect()
        assert name == "bpe" or given.columns == docs.columns
    rejected = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept["language_id"]}
    scores = by_id(langid.predict_languages(docs))
    assert rejected == {i for i, r in scores.items() if r.score < 0.5}
    groups = defaultdict(list)
    for r in kept["language_id"]:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(map(max, groups.values()))
    linked, _ = components({r.doc_id: r.text for r in kept["exact_dedup"]}, 5)
    assert {r.doc_id for r in kept["near_dedup"]} == {i for i, c in linked.items() if i == c}
    count = lambda data: sum((Counter({r.source: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))}) for r in data), Counter())
    wanted, mixed = targets(count(kept["near_dedup"])), count(kept["mixing"])
    assert all(abs(mixed[s] - t) <= 1 for s, t in wanted.items())
    coded = Counter((r.doc_id, tuple(r.ids)) for r in kept["bpe"])
    assert coded == Counter((r.doc_id, tuple(reference_encoder.encode(r.text, add_special_tokens=False).ids)) for r in kept["mixing"])
