"""Near-duplicate detection with SetSketch registers.

One pass over the texts gives each document the hash of its shingle set and a sketch: for every register, the least of
the set's exponential variates, truncated to a power of a base close to 1. Equal sets collapse to a class. Classes that
agree in a band of registers share a bucket. Buckets are not expanded into pairs: first the member that shares most
buckets is compared with the others of its bucket, in order of their likelihood: pairs that the joint likelihood of
their registers makes likely are confirmed on the full sets, and linked classes get one label. For the members of
buckets in which labels still differ, the pairs thought unlikely included, an exact prefix filter takes over: linked
sets must share one of their rarest shingles, so candidates follow the shingles that tell the members apart rather than
the pairs of a bucket. All of these are confirmed on the full sets: the likelihood orders the work and rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces
from millrace.llm.exact_dedup import filter_bits, membership_filter, with_may_repeat
from millrace.operators.components import connected_components
from millrace.runtime import cut

SHINGLE = 5
PERCENT = 80  # least similarity of a link
BANDS, ROWS = 59, 7  # a link at 80 % shares no band with a chance of 1e-6; sets at 30 % share one with 1 %
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.06, 4.0, 254  # a register is a byte, and tells sets of up to some 500,000 shingles apart
HUB_ROUNDS = 1
SIZE_STEP = 1.02  # ratio of the size classes of the prefix filter
#: A pair waits for the prefix filter when its likelihood at the least similarity is so far below the best.
LIKELIHOOD_GAP = 12.5
CLASS_ROWS, SET_ROWS, NARROW_ROWS = 16_384, 2_048, 100_000  # rows a partition of what is kept between steps
_COLUMNS = 512

_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, REGISTERS, np.uint32)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle, one without words has none.

    A-Z are lower-cased, words are split at the blanks 09-0D and 20. For 2^32 shingles in a text the chance of a
    collision is one half; texts are far below.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = max(1, len(words) - size + 1)
    state = np.full(n, len(words) if len(words) < size else size, _U)
    for i in range(min(size, len(words))):
        state = _mix(state * _U(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(state)


def sketch(items: np.ndarray) -> np.ndarray:
    """The registers (bytes) of a set of 64-bit hashes. Sketches of a union are the registers' maxima."""
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    short = (items ^ (items >> _U(32))).astype(np.uint32)
    for i in range(0, len(short), _COLUMNS):
        part = short[None, i : i + _COLUMNS] * _A[:, None]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP + 1).astype(np.uint8)


def bands(registers: np.ndarray) -> np.ndarray:
    """Rows of BANDS 64-bit bucket numbers for rows of registers."""
    parts = registers.reshape(-1, BANDS, ROWS).astype(_U)
    state = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), parts.shape[:2])
    for i in range(ROWS):
        state = _mix(state ^ (parts[:, :, i] + _U(1)) * _U(0xD6E8FEB86659FD93))
    return state.view(np.int64)


def plausible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int = PERCENT):
    """Whether two sets with these registers and sizes may have the similarity, and the likeliest similarity.

    With u and v the sets' shares of both sizes, registers of the first exceed those of the second with probability
    q(u - vJ), and the other way with q(v - uJ), q(x) = -log_b(1 - x (b - 1) / b). The likelihood of the three counts
    is compared on a grid of J.
    """
    more = (left > right).sum(axis=1)
    less = (left < right).sum(axis=1)
    total = (n_left + n_right).astype(np.float64)
    u, v = n_left / total, n_right / total
    most = np.minimum(u / v, v / u)
    q = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        up, down = q(u[:, None] - v[:, None] * j), q(v[:, None] - u[:, None] * j)
        same = np.clip(1 - up - down, 1e-12, 1)
        equal = REGISTERS - more - less
        return more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)

    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    values = likelihood(grid)
    best = values.argmax(axis=1)
    j = grid[np.arange(len(grid)), best]
    bound = percent / 100
    at_bound = likelihood(np.minimum(np.full((len(grid), 1), bound), most[:, None]))[:, 0]
    return (j >= bound) | (at_bound >= values.max(axis=1) - LIKELIHOOD_GAP), j


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                sets = [shingle_set(x, size) for x in piece.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.record_batch(
                    {
                        "doc_id": piece.column(0),
                        "set_key": pa.array(keys, pa.binary()),
                        "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                        "registers": pa.array([sketch(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                    }
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                sets = [shingle_set(x, size).view(np.int64) for x in piece.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                yield pa.record_batch({"doc_id": piece.column(0), "items": items})

    return run


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            registers = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            yield pa.record_batch(
                {
                    "rep": np.repeat(batch.column(0).to_numpy(), BANDS),
                    "n": np.repeat(batch.column(1).to_numpy(), BANDS),
                    "bucket": bands(registers).ravel(),
                }
            )


def _judged(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (4, 5)
                )
                keep, _ = plausible(left, right, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
                yield batch.filter(pa.array(keep)).select(["a", "b", "n_a", "n_b"])

    return run


class _Links:
    """Confirms candidate pairs of class representatives on their full sets."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n_a, n_b) whose registers make the similarity likely."""
        registers = self.classes.select("rep", "registers")
        return (
            pairs.join(registers.select(F.col("rep").alias("a"), F.col("registers").alias("r_a")), "a")
            .join(registers.select(F.col("rep").alias("b"), F.col("registers").alias("r_b")), "b")
            .select("a", "b", "n_a", "n_b", "r_a", "r_b")
            .mapInArrow(_judged(self.percent), "a long, b long, n_a long, n_b long")
        )

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among distinct pairs (a, b, n_a, n_b), a < b."""
        full = pairs.join(self.sets.select(F.col("doc_id").alias("a"), F.col("items").alias("s_a")), "a").join(
            self.sets.select(F.col("doc_id").alias("b"), F.col("items").alias("s_b")), "b"
        )
        common = F.size(F.array_intersect("s_a", "s_b"))
        return full.where(100 * common >= self.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("rep"))
    named = labels.select(F.col("node").alias("rep"), "component")
    return rows.join(named, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")


def _similar_sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of (rep, n, label) with (other, n_other, label_other) in different components."""
    kept = joined.where((F.col("label") != F.col("label_other")) & _similar_sizes("n", "n_other", percent))
    first = F.col("rep") < F.col("other")
    return kept.select(
        F.least("rep", "other").alias("a"),
        F.greatest("rep", "other").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("n_other")).alias("n_a"),
        F.when(first, F.col("n_other")).otherwise(F.col("n")).alias("n_b"),
    ).distinct()


def _least_common(n_a, n_b, percent: int):
    """Shingles that sets of these sizes must share to be linked."""
    return F.ceil(percent * (n_a + n_b) / (100 + percent)).cast("int")


def _size_class(n):
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Index and probe rows (token, class, rep, n, label, at) of the members' prefixes, rarest shingles first.

    A pair is looked for from its larger set. The smaller one is indexed with the shingles among which one is shared
    with any larger set it is linked to; the larger one probes each size class with as many as that class demands.
    """
    own = members.select("rep").join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
    tokens = own.select("rep", F.explode("items").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    ranked = tokens.join(common, "token", "left").groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("holders", F.lit(1)).alias("holders"), "token"))).alias("items")
    )  # the set of one document
    ranked = cut(ranked.join(members, "rep"), SET_ROWS)
    n = F.col("n").cast("int")
    row = ["rep", "n", "label", F.col("t.holders").alias("holders"), F.col("t.token").alias("token"), "at"]
    index = ranked.select(
        "rep", "n", "label", F.posexplode(F.slice("items", F.lit(1), n - _least_common(n, n, percent) + 1)).alias("at", "t")
    ).select(*row, _size_class(n).alias("class"))
    least = F.ceil(percent * n / 100).cast("int")
    probed = ranked.withColumn("class", F.explode(F.sequence(_size_class(least) - 1, _size_class(n))))
    low = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("class"))).cast("int"))
    length = F.greatest(F.lit(0), n - _least_common(low, n, percent) + 1)
    probe = probed.select(
        "rep", "n", "label", "class", F.posexplode(F.slice("items", F.lit(1), length)).alias("at", "t")
    ).select(*row, "class")
    return tuple(x.where("holders > 1").drop("holders") for x in (index, probe))


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components among (rep, n, label) members that may be linked: none is lost.

    Of two labels that meet under a key, one is not the key's most frequent: only rows of other labels meet all rows.
    """
    index, probe = _prefixes(members, sets, percent)
    index = index.select("token", "class", *(F.col(x).alias(f"{x}_other") for x in ("n", "label", "at")), F.col("rep").alias("other"))
    counts = index.groupBy("token", "class", "label_other").agg(F.count("*").alias("size"))
    usual = counts.groupBy("token", "class").agg(F.max(F.struct("size", "label_other"))["label_other"].alias("usual"))
    usual = cut(usual, NARROW_ROWS)
    probe, index = (cut(x.join(usual, ["token", "class"]), NARROW_ROWS) for x in (probe, index))
    smaller = (F.col("n_other") < F.col("n")) | ((F.col("n_other") == F.col("n")) & (F.col("other") < F.col("rep")))
    ahead = F.least(F.col("n") - F.col("at"), F.col("n_other") - F.col("at_other"))  # what they may still share
    enough = ahead >= _least_common(F.col("n"), F.col("n_other"), percent)
    apart = F.col("label") != F.col("label_other")
    first = probe.where("label <> usual").join(index.drop("usual"), ["token", "class"])
    second = probe.where("label = usual").join(index.where("label_other <> usual").drop("usual"), ["token", "class"])
    return _pairs(first.where(smaller & enough & apart).unionByName(second.where(smaller & enough)), percent)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every whole text.

    Documents whose sets of word shingles have at least ``percent`` of similarity are linked; the component is named by
    the smallest doc_id that links lead to. Texts without words, null ones included, are linked with nothing. A row is
    returned for each row: rows that share an id are one document, those without an id are linked with nothing, have a
    null component and are kept. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    each = cut(rows.mapInArrow(_sketches(shingle), "doc_id long, set_key binary, n_shingles long, registers binary"))
    some = each.where("n_shingles > 0 and doc_id is not null")
    classes = cut(
        some.groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")
        ),
        CLASS_ROWS,
    )
    labels = _class_components(rows, classes, shingle, percent)
    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    linked = some.select("doc_id", "set_key", "n_shingles").join(named, "set_key")
    alone = each.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return linked.select(*columns).unionByName(alone.select(*columns))


def _class_components(rows: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    buckets = classes.select("rep", "n", "registers").mapInArrow(_bucketed, "rep long, n long, bucket long")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    live = cut(buckets.join(shared, "bucket"), NARROW_ROWS)
    score = cut(live.groupBy("rep").agg(F.sum("members").alias("score")), NARROW_ROWS)
    live = live.drop("members")
    bits = filter_bits(score.count())
    bitmaps = cut(membership_filter(score, "rep", bits), CLASS_ROWS)
    wanted = with_may_repeat(rows, "doc_id", bitmaps, bits, "wanted").where("wanted").drop("wanted")
    # One row an id: of rows that share one, any set of the class will do that its representative has.
    sets = wanted.mapInArrow(_sets(shingle), "doc_id long, items array<bigint>").dropDuplicates(["doc_id"])
    sets = cut(sets, SET_ROWS)
    links = _Links(classes, sets, percent)
    found, labels = None, None
    scored = cut(live.join(score, "rep"), NARROW_ROWS) if HUB_ROUNDS else None
    for _ in range(HUB_ROUNDS):
        rows_now = _labelled(scored, labels)
        hub = rows_now.groupBy("bucket").agg(F.max(F.struct("score", -F.col("rep"), "n", "label")).alias("hub"))
        hub = hub.select("bucket", (-F.col("hub.col2")).alias("other"), F.col("hub.n").alias("n_other"), F.col("hub.label").alias("label_other"))
        joined = rows_now.join(hub, "bucket")
        scored = joined.where("rep <> other").select("bucket", "rep", "n", "score")
        new = links.confirm(links.likely(cut(_pairs(joined, percent), NARROW_ROWS)))
        found = cut(new if found is None else found.unionByName(new), NARROW_ROWS)
        labels = cut(connected_components(found), NARROW_ROWS)
    rows_now = _labelled(live, labels)
    open_buckets = rows_now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    members = rows_now.join(open_buckets.select("bucket"), "bucket", "left_semi").select("rep", "n", "label").distinct()
    members = cut(members, NARROW_ROWS)
    if members.take(1):
        new = cut(links.confirm(cut(_prefix_pairs(members, sets, percent), NARROW_ROWS)), NARROW_ROWS)
        if labels is None or new.take(1):
            labels = cut(connected_components(new if found is None else found.unionByName(new)), NARROW_ROWS)
    if labels is None:
        return classes.sparkSession.createDataFrame([], "node long, component long")
    return labels


def keep_representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps: one id of each component.

    Only rows whose id may be a dropped one (a broadcast Bloom filter of bounded size tells) shuffle with their texts.
    """
    decided = near_duplicates(docs, doc_id, text, shingle, percent)
    dropped = cut(decided.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct(), NARROW_ROWS)
    bits = filter_bits(dropped.count())
    bitmaps = cut(membership_filter(dropped, "__dropped", bits))
    keyed = docs.withColumn("__key", F.col(doc_id).cast("long"))
    tested = with_may_repeat(keyed, "__key", bitmaps, bits, "__may_drop")
    held = tested.where("__may_drop").join(dropped, F.col("__key") == F.col("__dropped"), "left_anti")
    return tested.where(~F.col("__may_drop")).select(*docs.columns).unionByName(held.select(*docs.columns))
