"""Periodic runs, licence scans and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import string
import zlib

import pytest
from edge_rows import rows
from pyspark.sql import functions as F

from millrace.llm import licences, merkle, periodic_runs, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def table_of(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# 11 ------------------------------------------------------------------------------------------------------------


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    proofs, now, place = [[] for _ in digests], digests, list(range(len(digests)))
    while len(now) > 1:
        for i, k in enumerate(place):
            low = k // 16 * 16
            proofs[i].append(("".join(now[low:k]), "".join(now[k + 1 : low + 16])))
            place[i] = k // 16
        now = [sha("".join(now[k : k + 16])) for k in range(0, len(now), 16)]
    return now[0], proofs


def plain_manifest(data):
    """Rows of op11 for (doc_id, source, lang, n_chars, text) rows."""
    leaf = lambda r: sha("".join(map(plain_field, r)))
    sources = sorted({r[1] for r in data}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        members = sorted((r for r in data if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, *plain_tree([leaf(r) for r in members])))
    if not trees:
        return []
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for (members, subroot, proofs), top in zip(trees, above, strict=True):
        for r, proof in zip(members, proofs, strict=True):
            folded = changed = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf((*r[:4], r[4].translate(LOWER)))
            for left, right in proof + top:
                folded = sha(left + folded + right)
            siblings = "".join(a + b for a, b in proof + top)
            out.append((r[0], changed, subroot, root, sha(siblings), folded, folded == root))
    return out


def manifest_rows(frame):
    return sorted(map(repr, map(tuple, merkle.manifest_digests(frame).collect())))


def test_manifest_equals_plain_trees(documents):
    data = [tuple(r) for r in documents.select(*ROWS).collect()]
    assert manifest_rows(documents) == sorted(map(repr, plain_manifest(data)))


@pytest.mark.parametrize("sizes", [[1], [1, 2, 16, 17, 256, 257], [4097], [1] * 40])
def test_manifest_of_every_depth(spark, sizes):
    data = [(s * 10_000 - i, None if s == 1 else f"source {s}", None, i, f"Text {i}") for s, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(data)
    frame = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_rows(frame) == sorted(map(repr, plain_manifest(data)))


def test_manifest_of_odd_rows(edge, empty):
    data = [tuple(r) for r in edge.select(*ROWS).collect()]
    assert manifest_rows(edge) == sorted(map(repr, plain_manifest(data)))
    assert manifest_rows(edge.repartition(7, "text")) == sorted(map(repr, plain_manifest(data)))
    assert merkle.manifest_digests(empty).count() == 0


def test_proofs_lead_to_the_root_and_catch_changes(documents):
    found = merkle.merkle_manifest(documents, extra={"changed": F.sha2(F.lit("another row"), 256)})
    to_root = merkle.fold_proof(F.col("leaf"), F.col("proof")) == F.col("root")
    changed = merkle.fold_proof(F.col("changed"), F.col("proof")) == F.col("root")
    first, second = found.select(F.min(to_root), F.max(changed)).first()
    assert first and not second
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof", "changed"]


# 12 ------------------------------------------------------------------------------------------------------------


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        phrase = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check_base(frame):
    texts = sorted(map(repr, (plain_base(r.text) for r in frame.collect())))
    got = licences.licence_labels(licences.scan_licences(frame)).collect()
    assert sorted(repr(tuple(r)[1:6]) for r in got) == texts
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    return got


def test_base_phrases_equal_plain_ones(documents, edge, empty):
    check_base(documents)
    check_base(edge)
    assert licences.licence_labels(licences.scan_licences(empty)).count() == 0


def test_base_phrases_in_odd_places(spark):
    texts = [
        "CC-BY cc by cc. BY", "cc by by cc cc", "ccby", "All rights: reserved? all RIGHTS reserved", "GENERAL\npublic\tLicense",
        "général public license", "general public licensé", "cc by", "cc_by", "\x00cc\x00by\x00", "all rights all rights reserved", "", None, "cc",
    ]
    got = check_base(rows(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    assert {r.doc_id: r.n_base for r in got}[0] == 3


def plain_notices(words, known, rarity):
    """Labels by trying every shift of every notice."""
    labels = set()
    for t in known:
        if t.base or not t.needed <= set(words):
            continue
        rare = sorted({w for w in t.words if w in words}, key=lambda w: (-rarity[w], w))[: licences.ANCHORS]
        need = max(2, (min(licences.ANCHORS, len(set(t.words))) + 1) // 2)
        shifts = sorted({p - k for p, w in enumerate(words) for k, x in enumerate(t.words) if x == w and w in rare})
        stretches = []
        for s in shifts:
            within = {w for w in rare for p, x in enumerate(words) for k, y in enumerate(t.words) if x == y == w and s - licences.SLACK <= p - k <= s}
            if len(within) >= need:
                low = min(x for x in shifts if x >= s - licences.SLACK)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1] = stretches[-1][0], s
                else:
                    stretches.append((low, s))
        for low, high in stretches:
            part = words[max(0, low - licences.SLACK) : high + len(t.words) + licences.SLACK]
            if all(any(tuple(part[i : i + len(p)]) == p for i in range(len(part))) for p in t.required):
                labels.add(t.label)
    return labels


def test_notices_equal_every_shift_tried(spark):
    rnd, known = random.Random(3), licences.templates()
    notices = [x for _, x, _ in licences.NOTICES]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            words += rnd.choices(["the", "of", "license", "filler", "words", "software", "under"], k=rnd.randrange(12))
            part = rnd.choice(notices).split()
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(part))
                part[at : at + rnd.randrange(2)] = rnd.choices(["Example", "Inc", "the"], k=rnd.randrange(3))
            words += part
        texts.append(" ".join(words))
    frame = rows(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    rarity = licences.word_rarity(frame, "text", known)
    for r in licences.scan_licences(frame).collect():
        assert {m.label for m in r.matches if not m.base} == plain_notices(licences.words_of(texts[r.doc_id]), known, rarity)


def test_notices_are_found_and_prose_is_left_alone(spark):
    data = [(label, x) for label, x, _ in licences.NOTICES]
    filler = "words that say nothing of terms and stand before and after what is looked for "
    frame = rows(spark, [(i, filler * 3 + x + ". " + filler, None, None) for i, (_, x) in enumerate(data)] + [(99, "the license of the software is free, all rights of any person", None, None)])
    found = {r.doc_id: r for r in licences.licence_labels(licences.scan_licences(frame)).collect()}
    assert all(label in found[i].labels.split(",") for i, (label, _) in enumerate(data))
    assert found[99].labels == "" and found[99].score == 0


# 13 ------------------------------------------------------------------------------------------------------------


def plain_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            end = i
            while end < n and words[end] == words[end - q]:
                end += 1
            start = i - q
            smaller = any(all(words[x] == words[x - r] for x in range(start + r, end)) for r in range(1, q))
            if end - start >= max(least, times * q) and not smaller:
                out.append((start, end - start, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("times,least", [(2, 2), (3, 5), (4, 6)])
def test_runs_equal_brute_force(times, least):
    rnd = random.Random(times)
    for _ in range(1500):
        kinds = rnd.choice([1, 2, 3, 5, 30])
        words = [rnd.randrange(kinds) for _ in range(rnd.randrange(50))]
        for _ in range(rnd.randrange(3)):
            if words:
                at = rnd.randrange(len(words))
                words[at:at] = words[at : at + rnd.randrange(1, 6)] * rnd.randrange(2, 8)
        assert periodic_runs.find_runs(words, least, times) == plain_runs(words, least, times)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept)


def test_runs_of_documents(spark, documents):
    short = documents.where("length(text) < 20000 or text is null")
    got = sorted(map(repr, map(tuple, periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_repeated_tails(short))).collect())))
    assert got == sorted(repr(plain_row(r.doc_id, r.text)) for r in short.collect())
    assert queries.QUERIES["op13_periodic_runs"](spark, SF).count() == documents.count()


def test_runs_of_odd_texts(spark, tmp_path, empty):
    texts = ["a " * 5, "a " * 6, "a a " * 7, "a\x1ca " * 6, "x a b a b a b a b y", "a b a b a b a", "", None, " \n\t\x0b\x0c\r ", "a a a a a a b b b b b b", "𝔘 é " * 9]
    # Ids with h % 10 = 0, whose texts are made to repeat, among others.
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    data = [(i, t, None, None) for i, t in zip([*range(-20, 0), None, None, *ids], texts * 6, strict=False)] + [(-20, "a " * 6, None, None)]
    frame = rows(spark, data)
    got = queries.QUERIES["op13_periodic_runs"](spark, table_of(spark, tmp_path, frame))
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(plain_row(r[0], r[1])) for r in data)
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(frame).collect()}
    assert found[-16].runs == [(1, 8, 2)] and found[-16].collapsed == "x a b y"
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_long_texts_stay_cheap():
    rnd = random.Random(5)
    base = [rnd.randrange(400) for _ in range(9000)]
    assert periodic_runs.find_runs([base[i % 9000] for i in range(60_000)]) == [(0, 60_000, 9000)]
    assert periodic_runs.find_runs(["w"] * 60_000) == [(0, 60_000, 1)]
