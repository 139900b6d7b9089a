"""Splits into train and test rows of exact sizes: stratified by class, or by time."""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.session import store

_PREFIX = 4  # hex digits of the first histogram: 65,536 buckets per class


def class_sizes(counts: dict[str, int], test_fraction: float) -> dict[str, int]:
    """Test rows per class: the whole test size rounds up, classes share it in proportion.

    The train rows are dealt by largest remainder; equal remainders go by name.
    """
    total = sum(counts.values())
    n_test = math.ceil(test_fraction * total)
    n_train = total - n_test
    if min(counts.values(), default=0) < 2:
        raise ValueError("every class needs at least 2 rows to be split.")
    if min(n_train, n_test) < len(counts):
        raise ValueError("both parts need at least one row per class.")
    exact = {c: n * n_train / total for c, n in counts.items()}
    train = {c: math.floor(x) for c, x in exact.items()}
    left = n_train - sum(train.values())
    for c in sorted(counts, key=lambda c: (train[c] - exact[c], c))[:left]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def _hashes(df: DataFrame, key: Sequence[str], seed: int) -> dict[str, Column]:
    """``_order``, a hash of the key, and ``_within``, one of the whole row."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    whole = [F.to_json(c) if "map<" in t else F.col(c) for c, t in df.dtypes]
    # the hashes skip nulls, also those inside of values
    whole += [F.to_json(c, {"ignoreNullFields": "false"}) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))]
    whole += [F.col(c).isNull() for c in df.columns]
    return {
        "_order": F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)),
        "_within": F.md5(F.concat_ws(":", F.lit(str(seed)), F.xxhash64(*whole).cast("string"), F.hash(*whole).cast("string"))),
    }


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: Sequence[str] = ("url",),
    test_fraction: float = 0.2,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. Which rows go where depends on the rows and ``seed``, not on their order or partitions.

    Rows are ordered by a hash of the key. Per class the hash of the last test
    row is found by counting, without sorting or moving the rows: a histogram of
    hash prefixes points to one bucket, and only the hashes in there are ranked.
    The split is then a comparison with that hash.

    Where a class must be cut between rows of one key, these are ordered by a hash
    of the whole row in the same way. Rows that are equal in every column are
    interchangeable: at the cut they are counted, and dealt out by number.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumns(_hashes(df, key, seed))
    spark, kind = df.sparkSession, df.schema[label].dataType.simpleString()
    slim = hashed.select(F.col(label).alias("class"), "_order", "_within")
    cuts = {c["class"]: c for c in _cuts(slim, kind, "_order", lambda counts: class_sizes(counts, test_fraction))}
    if not cuts:
        raise ValueError("no labelled rows to split.")
    inner = {c: v["take"] for c, v in cuts.items() if v["take"] < v["n"]}
    second = {}
    if inner:
        at = spark.createDataFrame([(c, cuts[c]["cut"]) for c in inner], f"class {kind}, _order string")
        second = {c["class"]: c for c in _cuts(slim.join(F.broadcast(at), ["class", "_order"]), kind, "_within", lambda _: inner)}
    # one row per class
    table = spark.createDataFrame(
        [
            (c, v["cut"], *((x["cut"], x["take"], x["n"]) if (x := second.get(c)) else ("~", 1, 1)))
            for c, v in cuts.items()
        ],
        f"_class {kind}, _cut string, _cut_within string, _take long, _n long",
    )
    marked = hashed.join(F.broadcast(table), F.col(label) == F.col("_class"))
    last = (F.col("_order") == F.col("_cut")) & (F.col("_within") == F.col("_cut_within"))
    parted = last & (F.col("_take") < F.col("_n"))
    is_test = (F.col("_order") < F.col("_cut")) | ((F.col("_order") == F.col("_cut")) & (F.col("_within") <= F.col("_cut_within")))
    copies = (
        marked.where(parted)
        .groupBy("_class", "_order", "_within", "_take")
        .agg(F.first(F.struct(*df.columns)).alias("row"), F.count(F.lit(1)).alias("n"))
    )

    def dealt(number):
        return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), number))).select("row.*")

    train, test = marked.where(~is_test).select(*df.columns), marked.where(is_test & ~parted).select(*df.columns)
    if any(c["take"] < c["n"] for c in second.values()):
        train, test = train.union(dealt(F.col("n") - F.col("_take"))), test.union(dealt(F.col("_take")))
    return train, test


def _cuts(rows: DataFrame, kind: str, order: str, sizes) -> list[dict]:
    """Per class the hash at which the wanted number of rows is reached.

    ``take`` of the ``n`` rows with that hash are needed. ``sizes`` makes the wanted
    numbers from the rows of each class.
    """
    spark = rows.sparkSession
    # small, and read twice
    prefixes = store(
        rows.groupBy("class", F.substring(order, 1, _PREFIX).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    )
    counts = {r["class"]: r["n"] for r in prefixes.rows.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return []
    wanted = spark.createDataFrame(list(sizes(counts).items()), f"class {kind}, wanted long")
    bucket = (
        _running(prefixes.rows, "prefix")
        .join(F.broadcast(wanted), "class")
        .where("upto >= wanted and upto - n < wanted")
        .select("class", "prefix", (F.col("wanted") - F.col("upto") + F.col("n")).alias("rest"))
    )
    inside = (
        rows.withColumn("prefix", F.substring(order, 1, _PREFIX))
        .join(F.broadcast(bucket), ["class", "prefix"])
        .groupBy("class", order, "rest")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = _running(inside, order).where("upto >= rest and upto - n < rest").collect()
    prefixes.drop()
    return [{"class": r["class"], "cut": r[order], "n": r["n"], "take": r["rest"] - r["upto"] + r["n"]} for r in found]


def _running(counts: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("class").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(w))


# --- by time -------------------------------------------------------------------

#: Digits of a hash that one histogram tells apart: 65,536 buckets.
_DIGITS = 4


def _steps(time: str) -> dict[str, Column]:
    """Columns that order rows by time, then by the hashes of ``_hashes``; each has few values where those before are equal."""
    micros, day = f"unix_micros(`{time}`)", 86_400_000_000
    steps = {
        "_s0": F.expr(f"({micros} - pmod({micros}, {day})) div {day}"),
        "_s1": F.expr(f"pmod({micros}, {day}) div 1000000"),
        "_s2": F.expr(f"pmod({micros}, 1000000)"),
    }
    for name in ("_order", "_within"):
        for first in range(0, 32, _DIGITS):
            digits = F.substring(name, first + 1, _DIGITS)
            steps[f"_s{len(steps)}"] = F.conv(digits, 16, 10).cast("long")
    return steps


@dataclass(frozen=True)
class _Cut:
    """Where the first so many rows end: the values of the first steps of the last of them.

    Of the ``n`` rows with these values ``take`` belong to the first ones; all, unless they are equal in every step.
    """

    at: tuple[int, ...]
    take: int
    n: int

    @property
    def inside(self) -> bool:
        return self.take < self.n


def _cut_after(slim: DataFrame, steps: Sequence[str], wanted: int) -> _Cut:
    """The cut after ``wanted`` rows, found by counting: each histogram looks only into the bucket that the last one led to."""
    at, rest, n = [], wanted, 0
    for step in steps:
        counts = slim.groupBy(step).agg(F.count(F.lit(1)).alias("n"))
        # a histogram of days, of a day's seconds, or of so many digits
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))
        found = upto.where((F.col("upto") >= rest) & (F.col("upto") - F.col("n") < rest)).first()
        at.append(found[step])
        rest, n = rest - found["upto"] + found["n"], found["n"]
        if rest == n:
            break
        slim = slim.where(F.col(step) == at[-1])
    return _Cut(tuple(at), rest, n)


def time_split(
    df: DataFrame, time: str = "published_at", key: Sequence[str] = ("url",), test_fraction: float = 0.2, gap: int = 0, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train rows, and the test rows that all come after them in time.

    The last rows by time, ``test_fraction`` of them and rounded up, are for testing. The ``gap`` rows before these are in
    neither part, so that prices some rows after a training article need not lie among the test articles. Rows without
    a time are left out.

    Rows of one time are ordered by a hash of the key, then by one of the whole row, and rows that are
    equal in every column are dealt out by number. So the parts depend on the rows alone, not on their order or partitions. No
    row is sorted or moved: the cut is found by counting days, then seconds of one day, and so on, and
    the parts are comparisons with it.
    """
    if not 0 <= gap:
        raise ValueError(f"a gap cannot be negative: {gap}")
    steps = _steps(time)
    marked = df.where(F.col(time).isNotNull()).withColumns(_hashes(df, key, seed)).withColumns(steps)
    slim = marked.select(*steps)
    total = slim.count()
    n_test = math.ceil(test_fraction * total)
    n_train = total - n_test - gap
    if n_train < 1 or n_test < 1:
        raise ValueError(f"{total} rows with a time leave no train or no test rows beside a gap of {gap}.")
    last_train = _cut_after(slim, list(steps), n_train)
    last_before = _cut_after(slim, list(steps), n_train + gap) if gap else last_train

    def place(cut: _Cut) -> tuple[Column, Column]:
        """Whether a row comes up to the cut, and whether it is among the equal rows that the cut divides."""
        own = F.struct(*list(steps)[: len(cut.at)])
        edge = F.struct(*[F.lit(v).cast("long").alias(s) for s, v in zip(steps, cut.at, strict=False)])
        return own <= edge, (own == edge) if cut.inside else F.lit(False)

    (upto, parted), (before, parted_before) = place(last_train), place(last_before)
    divided = parted | parted_before
    train = marked.where(upto & ~divided).select(*df.columns)
    test = marked.where(~before & ~divided).select(*df.columns)
    if last_train.inside or last_before.inside:
        copies = marked.where(divided).groupBy(*steps).agg(F.first(F.struct(*df.columns)).alias("row"), F.count(F.lit(1)).alias("n"))

        def dealt(number: Column) -> DataFrame:
            return copies.withColumn("n", number).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")

        train = train.union(dealt(F.when(parted, F.lit(last_train.take)).when(upto, F.col("n")).otherwise(0).cast("long")))
        test = test.union(dealt(F.when(parted_before, F.col("n") - F.lit(last_before.take)).when(before, F.lit(0)).otherwise(F.col("n")).cast("long")))
    return train, test
