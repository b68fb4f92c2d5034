"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source is a stream of words: its documents in a fixed order, cut into blocks of ``block_words``. A source's target
is an exact quota of words, drawn block by block in the order of a pseudo-random permutation of its blocks (computed by
arithmetic, never sorted); a target above the source's size passes through a second permutation. The draws of all
sources are dealt to output shards by a binary tree: each node splits the quotas it has between its halves by a
multivariate-hypergeometric draw, so shards are of equal size and quotas stay exact. The quotas of the leaves cut a
source's draws into disjoint ranges of permuted blocks, one a shard; a draw finds its own by descending the tree. Within its shard it has a pseudo-random place.

Only (doc_id, source, size) rows shuffle, by (source, bucket) with buckets of bounded size, so that a hot source is
spread; tables with one row a source or a tree node are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # of all words, what the targets add up to
MOST = 2  # times its size, what a target may be at most
BLOCK_WORDS = 512
BUCKET_ROWS = 10_000
SHARDS = 16
SEED = 7
SWAPS = 32  # rounds of the permutation of a source's blocks


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Add ``rank`` (by code point, null last) and ``target`` to rows of (source, source_size, ...), one a source.

    Weights repeat along the ranks. Sources whose share by weight would pass ``most`` times their size get just that,
    and the rest is reshared by weight until none is above.
    """
    ranked = cut(
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn(
            "weight", F.get(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int"))
        )
    )
    limit = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    for _ in range(200):
        full = F.col("weight") * level >= limit if level else F.col("source_size") < 0
        capped, free = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        after = (share * total - capped) / free if free else level
        if not free or after <= level:
            break
        level = after
    return ranked.withColumn("target", F.least(limit.cast("double"), F.col("weight") * level))


def _uniform(*parts: Column) -> Column:
    """A reproducible number in (0, 1) of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """The number of good ones among ``drawn`` out of ``total``, from a uniform number.

    Its distribution is inverted at u by the ratios of neighbouring probabilities, over ten standard deviations around
    the mean: the work grows as the root of what is drawn, a million steps for some 10^10 draws.
    """
    t, g, d = (x.cast("double") for x in (total, good, drawn))
    mean = F.when(t > 0, d * g / t).otherwise(0.0)
    variance = F.when(t > 1, d * g / t * (1 - g / t) * (t - d) / (t - 1)).otherwise(0.0)
    known = F.struct(
        total.alias("t"), good.alias("g"), drawn.alias("d"), mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd")
    )

    def inverted(s: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("x"))

        def after(w: Column, x: Column) -> Column:
            up = (s["g"] - x).cast("double") * (s["d"] - x)
            return w * up / ((x + 1).cast("double") * (s["t"] - s["g"] - s["d"] + x + 1))

        points = F.sequence(s["low"], s["high"])
        mass = F.aggregate(
            points, start, lambda a, x: F.struct(after(a["w"], x).alias("w"), (a["sum"] + a["w"]).alias("sum"), a["x"].alias("x"))
        )["sum"]

        def picked(wanted: Column) -> Column:
            return F.aggregate(
                points,
                start,
                lambda a, x: F.struct(
                    after(a["w"], x).alias("w"),
                    (a["sum"] + a["w"]).alias("sum"),
                    F.when(a["x"].isNull() & (a["sum"] + a["w"] >= wanted), x).otherwise(a["x"]).alias("x"),
                ),
            )["x"]

        return F.coalesce(_let(mass * u, picked), s["high"])

    def ranged(s: Column) -> Column:
        least = F.greatest(F.lit(0).cast("bigint"), s["d"] - (s["t"] - s["g"]))
        most = F.least(s["d"], s["g"])
        low = F.greatest(least, F.floor(s["mean"] - 10 * s["sd"]).cast("bigint"))
        high = F.least(most, F.ceil(s["mean"] + 10 * s["sd"]).cast("bigint"))
        fields = [s[x].alias(x) for x in ("t", "g", "d")]
        return _let(F.struct(*fields, low.alias("low"), F.greatest(low, high).alias("high")), inverted)

    return F.when(total > 0, _let(known, ranged)).otherwise(F.lit(0).cast("bigint"))


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(rank, left): for each source the quotas that go left at the tree's nodes, in heap order (root first).

    ``quotas`` has a row (rank, draws) a source. A node deals as many draws to its left half as that half's share of the
    shards; a source's part of them is hypergeometric given the parts of the sources before it.
    """
    levels = shards.bit_length() - 1
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "draws"))).alias("q")).select(
        F.lit(1).alias("node"), "q"
    )
    done = None
    for _ in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["draws"])
        node = node.withColumn("total", total).withColumn("room", F.floor((F.col("total") + 1) / 2).cast("long"))
        start = F.struct(F.col("total").alias("total"), F.col("room").alias("room"), F.array().cast("array<bigint>").alias("left"))

        def split(a: Column, x: Column) -> Column:
            return _let(
                hypergeometric(a["total"], x["draws"], a["room"], _uniform(F.lit(seed), F.col("node"), x["rank"])),
                lambda g: F.struct(
                    (a["total"] - x["draws"]).alias("total"),
                    (a["room"] - g).alias("room"),
                    F.array_append(a["left"], g).alias("left"),
                ),
            )

        node = cut(node.withColumn("left", F.aggregate("q", start, split)["left"]))
        level = node.select("node", F.posexplode("left").alias("i", "goes"), F.col("q")["rank"].alias("ranks")).select(
            "node", F.get("ranks", F.col("i")).alias("rank"), "goes"
        )
        done = level if done is None else done.unionByName(level)
        left = F.zip_with("q", "left", lambda x, g: F.struct(x["rank"].alias("rank"), g.alias("draws")))
        right = F.zip_with("q", "left", lambda x, g: F.struct(x["rank"].alias("rank"), (x["draws"] - g).alias("draws")))
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")),
        )
        node = node.select(F.explode(both).alias("n")).select("n.node", "n.q")
    if done is None:
        return quotas.select("rank", F.array().cast("array<bigint>").alias("left"))
    return done.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("node", "goes"))).alias("x")).select(
        "rank", F.col("x")["goes"].alias("left")
    )


def _permuted(block: Column, blocks: Column, *key: Column) -> Column:
    """The place of a block in the source's draw order: a permutation of 0 .. blocks - 1 at any number of blocks.

    In each of ``SWAPS`` rounds every place has one partner (their sum is a number of the round, modulo ``blocks``), and
    a hash of the pair's greater place tells whether the two change places.
    """

    def swapped(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, i), blocks) - x, blocks)
        trade = F.xxhash64(*key, -1 - i, F.greatest(x, partner)).bitwiseAND(1) == 1
        return F.when(trade, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), block, swapped)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken, pieces: one row a document.

    ``pieces`` lists what the mix takes of the document: structs (shard, place, turn, first, words), where ``first`` is
    the 0-based word at which a run of ``words`` words begins, ``turn`` counts the passes through the source, and ``place``
    orders the pieces of a shard. ``taken`` adds up their words; over a source it is its target, rounded. Null texts have no words; null sources are one source; null
    ids sort first; rows that repeat an id are taken like others. An empty table gives an empty result, and further
    columns are ignored, whatever their names. ``shards`` is a power of two.
    """
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
        )
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = source_targets(sources, weights, share, most)
    plan = plan.select(
        "source",
        "rank",
        "source_size",
        "target",
        F.round("target").cast("long").alias("quota"),
        F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks"),
        (F.floor(F.col("rows") / BUCKET_ROWS) + 1).cast("long").alias("buckets"),
    )
    # A pass draws every block once; what is left of the quota comes from the first blocks of one more permutation.
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("left_words", F.col("quota") - F.col("passes") * F.col("source_size"))
    # The last block is shorter by ``gap``; where it stands in the permutation of the last pass decides what precedes it.
    plan = plan.withColumn("gap", F.col("blocks") * block_words - F.col("source_size")).withColumn(
        "short_at",
        F.when(F.col("blocks") > 0, _permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("rank"), F.col("passes"))).otherwise(0),
    )
    before_short = F.col("short_at") * block_words
    part_blocks = F.when(F.col("left_words") <= before_short, F.ceil(F.col("left_words") / block_words)).otherwise(
        F.greatest(F.col("short_at") + 1, F.ceil((F.col("left_words") + F.col("gap")) / block_words))
    )
    plan = cut(plan.withColumn("draws", (F.col("passes") * F.col("blocks") + part_blocks).cast("long")))
    plan = cut(plan.join(splitting_tree(plan.select("rank", "draws"), shards, seed), "rank"))

    bucketed = rows.join(plan.select(F.col("source").alias("__s"), "rank", "buckets"), F.col("source").eqNullSafe(F.col("__s")))
    bucketed = cut(
        bucketed.select("doc_id", "text_hash", "source", "size", "rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "buckets").alias("bucket"))
    )
    sums = bucketed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    offsets = sums.withColumn("offset", F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words"))
    offsets = offsets.join(plan.drop("source"), "rank").drop("words", "buckets")
    within = Window.partitionBy("rank", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["rank", "bucket"])
    placed = placed.withColumn("from", F.col("offset") + F.col("before"))
    return _drawn(placed, block_words, shards, seed)


def _drawn(placed: DataFrame, width: int, shards: int, seed: int) -> DataFrame:
    """The pieces of each document that lies at the words [from, from + size) of its source."""
    start, size, blocks = F.col("from"), F.col("size"), F.col("blocks")
    levels = shards.bit_length() - 1

    def shard_of(draw: Column) -> Column:
        root = F.struct(F.lit(1).alias("node"), draw.alias("d"))
        if not levels:
            return F.lit(0)

        def down(s: Column, _: Column) -> Column:
            left = F.get(F.col("left"), s["node"] - 1)
            return F.when(s["d"] < left, F.struct((s["node"] * 2).alias("node"), s["d"].alias("d"))).otherwise(
                F.struct((s["node"] * 2 + 1).alias("node"), (s["d"] - left).alias("d"))
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), root, down)["node"] - shards

    def piece(block: Column, turn: Column) -> Column:
        at = _permuted(block, blocks, F.lit(seed), F.col("rank"), turn)

        def made(p: Column) -> Column:
            length = F.least(F.lit(width).cast("long"), F.col("source_size") - block * width)
            before = p * width - F.when(p > F.col("short_at"), F.col("gap")).otherwise(0)
            wanted = F.when(turn < F.col("passes"), length).otherwise(
                F.least(length, F.greatest(F.col("left_words") - before, F.lit(0).cast("long")))
            )
            low = F.greatest(block * width, start)
            high = F.least(block * width + wanted, start + size)
            draw = turn * blocks + p
            return F.struct(
                shard_of(draw).cast("int").alias("shard"),
                F.xxhash64(F.lit(seed), F.col("rank"), draw).alias("place"),
                turn.cast("int").alias("turn"),
                (low - start).alias("first"),
                F.greatest(high - low, F.lit(0).cast("long")).alias("words"),
            )

        return _let(at, made)

    turns = F.sequence(F.lit(0).cast("long"), F.col("passes"))
    touched = F.sequence(F.floor(start / width).cast("long"), F.floor((start + size - 1) / width).cast("long"))
    pieces = F.filter(
        F.flatten(F.transform(turns, lambda t: F.transform(touched, lambda b: piece(b, t)))), lambda x: x["words"] > 0
    )
    none = F.array().cast("array<struct<shard:int,place:bigint,turn:int,first:bigint,words:bigint>>")
    out = placed.withColumn("pieces", F.when(size > 0, pieces).otherwise(none))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"), "pieces")


_BLANK = r"[\x20\x09-\x0D]"


def _with_texts(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """The distinct (id, text) rows of ``docs`` with the pieces that the mix takes of all rows alike."""
    mixed = mix(docs, doc_id, text, **options).where("taken > 0")
    taken = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.flatten(F.collect_list("pieces")).alias("__pieces")
    )
    keyed = docs.withColumns({"__id2": F.col(doc_id), "__hash2": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    keyed = keyed.dropDuplicates(["__id2", "__hash2"])
    same = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2"))
    return keyed.join(taken, same).drop("__id", "__id2", "__hash", "__hash2")


def _words_with_blanks(text: Column) -> Column:
    """The words of a text, each with the blanks before it."""
    return F.regexp_extract_all(text, F.lit(f"({_BLANK}*{WORD})"), F.lit(1))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix as documents: for each pass, the text that it takes of a document, with the columns of ``docs``.

    A document taken twice makes two rows; one of which a pass takes some words keeps these, in their order and with
    their blanks, and ``n_chars``, where there is such a column, follows. Documents that the mix does not take go.
    """
    rows = _with_texts(docs, doc_id, text, **options)
    turns = F.array_distinct(F.transform("__pieces", lambda p: p["turn"]))
    rows = rows.withColumn("__turn", F.explode(turns)).withColumn(
        "__own", F.array_sort(F.transform(F.filter("__pieces", lambda p: p["turn"] == F.col("__turn")), lambda p: F.struct(p["first"].alias("first"), p["words"].alias("words"))))
    )
    count = F.aggregate("__own", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    units = _words_with_blanks(F.col(text))
    cutout = _let(
        units,
        lambda u: F.array_join(
            F.flatten(F.transform("__own", lambda p: F.slice(u, p["first"].cast("int") + 1, p["words"].cast("int")))), ""
        ),
    )
    rows = rows.withColumn(text, F.when(count == word_count(F.col(text)), F.col(text)).otherwise(cutout))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def write_mixture(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **options) -> None:
    """Write the pieces as Parquet folders ``shard=<n>``, in each in their pseudo-random places.

    Rows: doc_id, text (the piece's words with the blanks before them).
    """
    shards = options.get("shards", SHARDS)
    rows = _with_texts(docs, doc_id, text, **options)
    pieces = rows.select(
        F.col(doc_id).alias("doc_id"), _words_with_blanks(F.col(text)).alias("all"), F.explode("__pieces").alias("p")
    )
    (
        pieces.select(
            "doc_id",
            F.array_join(F.slice("all", F.col("p.first").cast("int") + 1, F.col("p.words").cast("int")), "").alias("text"),
            "p.shard",
            "p.place",
        )
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "place", "doc_id")
        .drop("place")
        .write.partitionBy("shard")
        .parquet(path)
    )
