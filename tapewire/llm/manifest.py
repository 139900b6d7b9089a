"""A Merkle manifest of a dataset: one tree per source, a tree of their roots, and a witness for every row.

Trees grow by appending. What is open at each level is a run of up to ``FAN`` nodes; every leaf below
them has a witness that is complete up to there, and gets its next step when the run closes. Blocks of
``FAN ** levels`` leaves, aligned by their place in the source, are appended to by different tasks, and
the roots of the blocks are the next appends, until each source is one node.
"""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.session import Stored, durable, store

FAN = 16
#: Levels that one task builds: 4,096 leaves.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<place: int, siblings: string>>"
_STEP = pa.struct([pa.field("place", pa.int32()), pa.field("siblings", pa.string())])


def _field(value: Column) -> Column:
    """A value that can't be mistaken for another: its length goes before it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row with these values."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def proof_digest(witness: Column) -> Column:
    """The digest of all siblings of a witness, from the leaf up."""
    return F.sha2(F.array_join(F.transform(witness, lambda step: step["siblings"]), ""), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""

    def up(node: Column, step: Column) -> Column:
        before = step["place"] * 64
        return F.sha2(F.concat(F.substr(step["siblings"], F.lit(1), before), node, F.substr(step["siblings"], before + 1)), 256)

    return F.aggregate(witness, leaf, up)


# --- appending -----------------------------------------------------------------


class OpenTree:
    """A tree that is appended to, at most ``levels`` high, with the witnesses of its leaves so far."""

    def __init__(self, levels: int, witnesses: bool = True):
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]
        self.steps: list[list[tuple[int, str]]] | None = [] if witnesses else None
        self.n = 0

    def append(self, digest: str) -> None:
        if self.steps is not None:
            self.steps.append([])
        self.n += 1
        self._push(0, (digest, self.n - 1, self.n))

    def _push(self, level: int, node: tuple[str, int, int]) -> None:
        """``node``: a digest and the leaves below it, first and past last."""
        self.open[level].append(node)
        if level < self.levels and len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [node[0] for node in run]
        if self.steps is not None:
            for place, (_, first, last) in enumerate(run):
                step = (place, "".join(digests[:place] + digests[place + 1 :]))
                for steps in self.steps[first:last]:
                    steps.append(step)
        self._push(level + 1, (hashlib.sha256("".join(digests).encode()).hexdigest(), run[0][1], run[-1][2]))

    def finish(self, whole: bool) -> str:
        """The root, with all runs closed. A whole tree ends where one node is left, a part of one at the top level."""
        for level in range(self.levels):
            if whole and len(self.open[level]) == 1 and not any(self.open[level + 1 :]):
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def _lists(steps: list[list[tuple[int, str]]]) -> pa.Array:
    flat = [s for own in steps for s in own]
    places, siblings = pa.array([p for p, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.string())
    bounds = np.cumsum([0, *map(len, steps)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([places, siblings], fields=list(_STEP)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from rows sorted by key and block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = batch.column("key"), batch.column("block").to_numpy()
        new = np.zeros(len(blocks), bool)
        new[1:] = (blocks[1:] != blocks[:-1]) | np.asarray(keys.slice(1).to_numpy(False) != keys.slice(0, len(keys) - 1).to_numpy(False))
        new[0] = bool(held) and (held[-1].column("block")[-1] != batch.column("block")[0] or held[-1].column("key")[-1] != keys[0])
        first = 0
        for at in np.flatnonzero(new).tolist():
            if at > first:
                held.append(batch.slice(first, at - first))
            yield pa.Table.from_batches(held)
            held, first = [], at
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _grown(table: pa.Table, levels: int, witnesses: bool) -> tuple[str, list]:
    """Root and witnesses of the leaves of a block. The only block of a source, if it is not full, is a whole tree."""
    tree = OpenTree(levels, witnesses)
    for digest in table.column("digest").to_pylist():
        tree.append(digest)
    root = tree.finish(whole=table.column("block")[0].as_py() == 0 and table.num_rows < FAN**levels)
    return root, tree.steps or []


def _roots(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            root, _ = _grown(table, levels, witnesses=False)
            yield pa.RecordBatch.from_pydict({"key": pa.array([table.column("key")[0].as_py()], pa.string()), "pos": pa.array([table.column("block")[0].as_py()], pa.int64()), "digest": [root]})

    return run


def _members(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            root, steps = _grown(table, levels, witnesses=True)
            columns = [table.column(c).combine_chunks() for c in ("key", "pos", "block")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([root] * table.num_rows, pa.string()), _lists(steps)], names=["key", "pos", "block", "root", "witness"])

    return run


def _leaves(levels: int):
    """Blocks of leaves, each after a row without a place that has the witness of the block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            top, rows = table.slice(0, 1).to_pylist()[0], table.slice(1)
            above = [(s["place"], s["siblings"]) for s in top["witness"]]
            _, steps = _grown(rows, levels, witnesses=True)
            columns = [rows.column(c).combine_chunks() for c in ("id", "digest", "given")]
            subroot = pa.array([top["digest"]] * rows.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, subroot, _lists([own + above for own in steps])], names=["id", "leaf", "given", "subroot", "witness"])

    return run


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes dealt out by block, in order. No block has more than ``FAN ** levels``, however large its source."""
    blocked = nodes.withColumn("block", F.expr(f"pos div {FAN**levels}"))
    return blocked.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _climb(nodes: DataFrame, levels: int) -> Stored:
    """Witness (to the root of its key) and root of every node, stored. ``nodes``: key, pos and digest.

    Each round builds ``levels`` levels, so that there are as many as the logarithm of the largest tree.
    """
    rounds: list[Stored] = []
    while True:
        rounds.append(store(_dealt(nodes, levels).mapInArrow(_members(levels), f"key string, pos long, block long, root string, witness {_STEPS}")))
        blocks = rounds[-1].rows
        if blocks.where("block > 0").isEmpty():
            break
        nodes = blocks.where(f"pos % {FAN**levels} = 0").select("key", F.col("block").alias("pos"), F.col("root").alias("digest"))
    found = blocks.select("key", "pos", "root", "witness")
    for below in reversed(rounds[:-1]):
        above = found.select("key", F.col("pos").alias("block"), F.col("root").alias("top"), F.col("witness").alias("rest"))
        joined = below.rows.join(above, ["key", "block"])
        found = joined.select("key", "pos", F.col("top").alias("root"), F.concat("witness", "rest").alias("witness"))
    climbed = store(found)
    for done in rounds:
        done.drop()
    return climbed


# --- numbering -----------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, with their number within key and range."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy(False)
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(heads, len(keys)))
        start = np.zeros(len(heads), np.int64)
        start[0] = n if keys[0] == last else 0
        number = np.arange(len(keys)) - np.repeat(heads, sizes) + np.repeat(start, sizes)
        last, n = keys[-1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(number)], names=[*batch.schema.names, "part", "no"])


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The place ``pos`` of each row among those of its ``key``, in this order.

    Rows are numbered within ranges, and a key that goes on in the next ranges is carried over by the counts of these.
    Only the first key of a range can go on from the one before, so what is broadcast has one row per range at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "key", *order).sortWithinPartitions("key", *order)
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    counted = durable(ranged.mapInArrow(_counted, f"{kinds}, part int, no long"))
    sizes = counted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.sum("size").over(earlier)).where("base > 0").select("key", "part", "base")
    placed = counted.join(F.broadcast(base), ["key", "part"], "left").withColumn("pos", F.col("no") + F.coalesce("base", F.lit(0)))
    return placed.select(*rows.columns, "pos")


def witnesses(
    docs: DataFrame,
    leaf: Column,
    given: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    levels: int = LEVELS,
) -> DataFrame:
    """Leaf, roots and witness of every row.

    ``leaf`` is the digest of a row; ``given`` is one of what the row has become since, where it is to be tried against
    the witness. Leaves of a source ascend by id, null first, then by digest; rows with the same id and digest are
    interchangeable. A null source is one of its own, before the others, which are in the order of their bytes.
    The only leaf of a source is its root. An empty table has no rows, and no root.

    No text is shuffled, only digests, twice. Sources are cut by range while they are numbered and by blocks
    after that, so one that holds most rows is spread like many. Returns doc_id, leaf, given, subroot, root and
    witness (steps from the leaf to the root: place in the run, and the digests of the others joined).
    """
    # null first; a mark keeps it apart from an empty name
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    slim = docs.select(
        key.alias("key"),
        F.col(id_col).cast("long").alias("id"),
        leaf.alias("digest"),
        (F.lit(None).cast("string") if given is None else given).alias("given"),
        F.monotonically_increasing_id().alias("copy"),  # lets a range end between equal rows
    )
    leaves = store(slim)
    placed = _numbered(leaves.rows, "id", "digest", "copy")
    leaves.drop()
    blocks = store(_dealt(placed.select("key", "pos", "digest"), levels).mapInArrow(_roots(levels), "key string, pos long, digest string"))
    inner = _climb(blocks.rows, levels)
    blocks.drop()

    named = store(inner.rows.where("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest")))
    sources = _numbered(named.rows, "name")
    named.drop()
    outer = _climb(sources.select("key", "pos", "digest"), levels)
    rest = sources.select("pos", "name").join(outer.rows.select("pos", F.col("witness").alias("rest")), "pos")
    root = outer.rows.select("root").first()
    top = inner.rows.withColumnRenamed("root", "subroot").join(rest.select(F.col("name").alias("key"), "rest"), "key")

    kept = ["key", "block", "pos", "id", "digest", "given"]
    rows = placed.withColumn("block", F.expr(f"pos div {FAN**levels}")).select(*kept, F.lit(None).cast(_STEPS).alias("witness"))
    heads = top.select(
        "key",
        F.col("pos").alias("block"),
        F.lit(-1).cast("long").alias("pos"),
        F.lit(None).cast("long").alias("id"),
        F.col("subroot").alias("digest"),
        F.lit(None).cast("string").alias("given"),
        F.concat("witness", "rest").alias("witness"),
    )
    met = rows.union(heads).repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    found = met.mapInArrow(_leaves(levels), f"id long, leaf string, given string, subroot string, witness {_STEPS}")
    return found.select(F.col("id").alias("doc_id"), "leaf", "given", "subroot", F.lit(root and root["root"]).cast("string").alias("root"), "witness")


def tampered(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """For a fifth of the rows, by the checksum of the id, the leaf of the row with A-Z in its text lower-cased; else null.

    A null id counts as an empty one.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = [F.translate(c, upper, upper.lower()) if c == text_col else F.col(c) for c in fields]
    checksum = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.when(checksum % 5 == 0, leaf_digest(*changed))


def verified_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, tried on rows of which a fifth have been tampered with.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (from the leaf found and the witness) and verified.
    """
    found = witnesses(docs, leaf_digest(*[F.col(c) for c in fields]), tampered(docs, fields), levels=levels)
    proven = found.withColumn("folded_root", folded(F.coalesce("given", "leaf"), F.col("witness")))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("witness")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
