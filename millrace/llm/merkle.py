"""Merkle manifest of a dataset: one digest that any row's short proof leads to.

Rows are leaves, in order of their ids within a group; every run of ``FAN`` consecutive nodes has a parent until one node
of the group remains, and the groups' nodes have a tree of their own above them. A distributed traversal numbers the
nodes of every tree, gathers aligned blocks of ``FAN ** DEPTH`` nodes and walks each block in postorder: the walk of a
subtree returns its digest and, while it unwinds, appends each child's siblings to the proofs of the leaves below that
child. The blocks' roots are the nodes of the next traversal. On the way back every block is walked once more with the
proof of its root, so that proofs are made where their leaves lie and only digests travel.

A block is the largest group of rows that meets in a task, however many rows a tree has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.runtime import cut

FAN = 16  # nodes of a parent
DEPTH = 2  # levels of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Proof = list[tuple[str, str]]  # of a node: the digests left and right of its own in each run, from the lowest

PROOF = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value as the digests see it: ``-`` for null, else the number of its UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in their order."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, p: F.sha2(F.concat(p["left"], own, p["right"]).cast("binary"), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof in their order, as one text."""
    return F.aggregate(proof, F.lit(""), lambda text, p: F.concat(text, p["left"], p["right"]))


def _parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _walk(leaves: list[str], low: int, high: int, level: int, proofs: list[Proof] | None) -> str:
    """Digest of the subtree of ``level`` levels over ``leaves[low:high]``; appends siblings to the proofs of its leaves."""
    if not level:
        return leaves[low]
    width = FAN ** (level - 1)
    starts = range(low, high, width)
    runs = [_walk(leaves, a, min(a + width, high), level - 1, proofs) for a in starts]
    if proofs is not None:
        for k, a in enumerate(starts):
            siblings = "".join(runs[:k]), "".join(runs[k + 1 :])
            for i in range(a, min(a + width, high)):
                proofs[i].append(siblings)
    return _parent(runs)


def _levels(nodes: int, of: int) -> int:
    """Levels of a block of ``nodes`` nodes in a tree of ``of``: all, unless the block is the whole tree."""
    if of > FAN**DEPTH:
        return DEPTH
    level = 0
    while FAN**level < nodes:
        level += 1
    return level


def walk_block(leaves: list[str], of: int | None = None) -> tuple[str, list[Proof]]:
    """(digest, proofs of the leaves) of an aligned block of at most ``FAN ** DEPTH`` nodes in a tree of ``of`` nodes."""
    proofs: list[Proof] = [[] for _ in leaves]
    return _walk(leaves, 0, len(leaves), _levels(len(leaves), of or len(leaves)), proofs), proofs


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tree, block, of, nodes = (batch.column(x) for x in ("tree", "block", "of", "nodes"))
        digests = []
        for n, row in zip(of.to_pylist(), nodes, strict=True):
            leaves = row.values.field("digest").to_pylist()
            digests.append(_walk(leaves, 0, len(leaves), _levels(len(leaves), n), None))
        yield pa.record_batch([tree, block, of, pa.array(digests, pa.string())], ["tree", "at", "of", "digest"])


def _proofs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each node of the blocks, with its whole proof: that within the block and that of the block's root."""
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            nodes = row.column("nodes").flatten()
            leaves = nodes.field("digest").to_pylist()
            _, proofs = walk_block(leaves, row.column("of")[0].as_py())
            above = [(x["left"], x["right"]) for x in row.column("above")[0].as_py()]
            for low in range(0, len(leaves), FAN):  # a proof is far larger than its node
                shown = [[{"left": a, "right": b} for a, b in proof + above] for proof in proofs[low : low + FAN]]
                part = nodes.slice(low, FAN)
                same = {x: pa.array(row.column(x).to_pylist() * len(part), row.column(x).type) for x in ("tree", "root") if x in columns}
                made = same | {"proof": pa.array(shown, pa.list_(pair))}
                yield pa.record_batch([made[x] if x in made else part.field(x) for x in columns], columns)


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``at``, a node's place in its ``tree`` by ``order`` from 0 on, and ``of``, the nodes of the tree.

    Nodes are range-partitioned and sorted, so that a tree of any size is spread over tasks; places count within a
    partition, plus what the partitions before hold of the tree.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
    placed = cut(dealt.select("*", F.monotonically_increasing_id().alias("__row"), F.spark_partition_id().alias("__part")))
    held = placed.groupBy("tree", "__part").agg(F.count("*").alias("__held"), F.min("__row").alias("__first"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("__held").over(by_tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(
        "tree",
        "__part",
        "__first",
        F.coalesce(before, F.lit(0)).alias("__before"),
        F.sum("__held").over(by_tree).alias("of"),
    )
    place = F.col("__row") - F.col("__first") + F.col("__before")
    return placed.join(cut(offsets), ["tree", "__part"]).withColumn("at", place).drop("__row", "__part", "__first", "__before")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, block, of, nodes): the aligned blocks of numbered nodes, each an array of at most ``FAN ** DEPTH``."""
    size = F.lit(FAN**DEPTH)
    node = F.struct("at", "digest", *carried)
    grouped = nodes.groupBy("tree", F.floor(F.col("at") / size).alias("block"))
    return cut(grouped.agg(F.first("of").alias("of"), F.array_sort(F.collect_list(node)).alias("nodes")))


_HEAD = "tree string, at long, of long, digest string"


def _trees(nodes: DataFrame, carried: list[str]) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """(tree, digest) of the trees of numbered nodes, and of each traversal the blocks and those of finished trees."""
    rounds, roots = [], None
    while True:
        blocks = _blocks(nodes, carried)
        whole = F.col("of") <= FAN**DEPTH
        folded = cut(blocks.mapInArrow(_roots, _HEAD))
        done = folded.where(whole).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        rounds.append((blocks, whole))
        left = folded.where(~whole)
        if not left.take(1):
            return roots, rounds
        nodes = left.withColumn("of", F.ceil(F.col("of") / FAN**DEPTH))
        carried = []


def _unwound(rounds: list[tuple[DataFrame, Column]], tops: DataFrame, carried: list[str], schema: str) -> DataFrame:
    """(tree, root, ``carried``, digest, proof) of the first traversal's nodes; ``tops``: (tree, root, above) of the trees."""
    below = None
    for k in range(len(rounds) - 1, -1, -1):
        blocks, whole = rounds[k]
        found = blocks.where(whole).join(tops, "tree")
        if below is not None:
            above = below.select("tree", F.col("at").alias("block"), "root", F.col("proof").alias("above"))
            found = found.unionByName(blocks.where(~whole).join(above, ["tree", "block"]).select(*found.columns))
        columns = ["tree", "root", "at", "digest", "proof", *(carried if not k else [])]
        kinds = f"tree string, root string, at long, digest string, proof {PROOF}{schema if not k else ''}"
        below = found.mapInArrow(lambda batches, c=columns: _proofs(batches, c), kinds)
        if k:
            below = cut(below)
    return below


def merkle_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    key: str = "doc_id",
    group: str = "source",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, group, leaf, subroot, root and proof, and the columns of ``extra``.

    ``leaf`` is the digest of the row's ``fields``, ``subroot`` that of its group's tree and ``root`` that of the groups'
    tree, the groups in the order of their UTF-8 bytes, null first. ``proof`` has for each level, from the lowest, the
    digests left and right of the row's own; ``fold_proof`` leads from it to the root.

    Leaves ascend by key, null keys first; rows that repeat a key follow in the order of their leaves, so the digests do
    not depend on the order of the input, and equal rows have equal leaves but proofs of their own. A null field counts
    as null, not as an empty text. An empty table has no rows and no root. Columns outside ``fields`` do not enter any
    digest, whatever their names; ``extra`` must be short, its columns travel with the leaves.
    """
    extra = extra or {}
    named = {"key": F.col(key), **extra}
    # A null group and its order: the empty text stands before all that begin with a sign.
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), leaf_digest(*map(F.col, fields)).alias("digest"), *[c.alias(f"_{x}") for x, c in named.items()])
    carried = [f"_{x}" for x in named]
    roots, rounds = _trees(_numbered(leaves, ["_key", "digest"]), carried)
    # The groups are the nodes of one more tree; its one name stands for all of them.
    groups = cut(_numbered(roots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("_tree")), ["_tree"]))
    root, above = _trees(groups, ["_tree"])
    top = root.select("tree", F.col("digest").alias("root"), F.from_json(F.lit("[]"), PROOF).alias("above"))
    tops = _unwound(above, top, ["_tree"], ", _tree string").select(
        F.col("_tree").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("above")
    )
    return _finish(rounds, cut(tops), carried, leaves, docs, key, group, named)


def _finish(rounds, tops, carried, leaves, docs, key, group, named) -> DataFrame:
    kinds = "".join(f", {x} {leaves.schema[x].dataType.simpleString()}" for x in carried)
    # The subroot and the root are the same for a whole tree: they travel in one column.
    both = F.concat("subroot", "root")
    proven = _unwound(rounds, tops.select("tree", both.alias("root"), "above"), carried, kinds)
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 2147483647)).cast(docs.schema[group].dataType)
    return proven.select(
        F.col("_key").alias(key),
        source.alias(group),
        F.col("digest").alias("leaf"),
        F.substring("root", 1, 64).alias("subroot"),
        F.substring("root", 65, 64).alias("root"),
        "proof",
        *[F.col(f"_{x}").alias(x) for x in named if x != "key"],
    )


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row of ``documents`` whose text has been lower-cased in A-Z, null where that is not to happen.

    One row in five is tampered with: those whose decimal id has a CRC-32 that 5 divides. Null ids have none.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = leaf_digest(*[F.translate("text", upper, upper.lower()) if x == "text" else F.col(x) for x in FIELDS])
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed)


def manifest_digests(docs: DataFrame) -> DataFrame:
    """Rows of the manifest of ``documents``, with digests of their proofs and the check of one row in five tampered with."""
    rows = merkle_manifest(docs, extra={"tampered": tampered_leaf(docs)})
    folded = fold_proof(F.coalesce("tampered", "leaf"), F.col("proof"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
