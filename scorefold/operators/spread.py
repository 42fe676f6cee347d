"""Picks that lie far apart: the farthest pair and its split, the medoid and farthest-point sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lineage import settled
from .ranking import place

#: Rows of a part at most, about; two parts meet in a cell.
BLOCK = 32_768
#: Rows a group that medoids are bounded by.
ASKED = 64


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, x: t + x))


def _usable(rows: DataFrame, group: list[str], key: str, vector: str) -> DataFrame:
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & whole).select(*group, F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))


def _classes(rows: DataFrame, group: list[str], key: str, vector: str) -> DataFrame:
    """group, key, v, n: the distinct vectors of each group, each with its first key and its number of rows."""
    return _usable(rows, group, key, vector).groupBy(*group, "v").agg(F.min("key").alias("key"), F.count(F.lit(1)).cast("double").alias("n")).select(*group, "key", "v", "n").transform(settled)


def _middle(usable: DataFrame, group: list[str]) -> DataFrame:
    """group, _m: the mean vector."""
    middle = usable.select(*group, F.posexplode("v").alias("at", "x")).groupBy(*group, "at").agg(F.avg("x").alias("x"))
    return middle.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("_m"))  # one number a component


def _farthest(rows: DataFrame, group: list[str], by: str) -> DataFrame:
    """group, key, v, by: the row of each group with the largest ``by``, of equal ones the first; no sort of vectors."""
    top = rows.groupBy(*group).agg(F.max(by).alias("_t"))
    first = rows.join(top, group).where(F.col(by) == F.col("_t")).groupBy(*group).agg(F.min("key").alias("key"))
    return rows.join(first, [*group, "key"]).select(*group, "key", "v", by)


def _matrix(side: pa.Table) -> np.ndarray:
    v = side["v"].combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1)


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b`` from the differences of their components."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x[:, None] - y) ** 2
    return np.sqrt(total)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products: fast, but off by about the rounding of the squared lengths."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def _tiles(a: int, b: int, rows: int = 256, columns: int = 2048):
    for i in range(0, a, rows):
        for j in range(0, b, columns):
            yield slice(i, i + rows), slice(j, j + columns)


def _typed(df: DataFrame, more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], more])


def _met(a: DataFrame, b: DataFrame, group: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], more: str) -> DataFrame:
    """group and what ``run`` gives for each cell of rows of ``a`` and ``b`` with the same group, _i and _j."""
    names = [*group, "_i", "_j"]
    schema = StructType.fromDDL(_typed(a.select(*group), more))
    nothing = to_arrow_schema(schema).empty_table()

    def cell(key: tuple, here: pa.Table, there: pa.Table) -> pa.Table:
        if not (len(here) and len(there)):
            return nothing
        out = run(here, there)
        kept = [pa.array([k.as_py()] * len(out), k.type) for k in key[: len(group)]]
        return pa.table([*kept, *out.columns], names=[*group, *out.column_names])

    a, b = a.toDF(*a.columns), b.toDF(*b.columns)  # columns of their own, where both come from one table
    return a.groupBy(*names).cogroup(b.groupBy(*names)).applyInArrow(cell, schema)


def _dealt(a: DataFrame, b: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows of ``a`` and ``b`` with the numbers _i and _j of the cells that they meet in."""
    sides, counts = [a, b], []
    for side, c in zip(sides, ("_a", "_b"), strict=True):
        counts.append(side.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(c)))
    cells = counts[0].join(counts[1], group).transform(settled)
    own = [F.pmod(F.xxhash64("key"), F.col(c)) for c in ("_a", "_b")]
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    return (
        a.join(cells, group).withColumn("_i", own[0]).withColumn("_j", all_of("_b")).drop("_a", "_b"),
        b.join(cells, group).withColumn("_j", own[1]).withColumn("_i", all_of("_a")).drop("_a", "_b"),
    )


def _best_pair(here: pa.Table, there: pa.Table) -> pa.Table:
    """The farthest pair of two parts, of equal ones the first."""
    a, b = _matrix(here), _matrix(there)
    middle = a.mean(0)
    near, far = a - middle, b - middle
    keys = [side["key"].to_pylist() for side in (here, there)]
    off = 1e-11 * ((near * near).sum(1).max() + (far * far).sum(1).max())
    best, least = None, -1.0
    for rows, columns in _tiles(len(a), len(b)):
        squares = _squares(near[rows], far[columns])
        i, j = np.nonzero(squares >= max(squares.max(), least) - off)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)] + rows.start, j[at : at + (1 << 16)] + columns.start
            exact = np.sqrt(((a[x] - b[y]) ** 2).sum(1))
            for n in np.flatnonzero(exact >= max(exact.max(), best[0] if best else 0)):
                p, q = keys[0][x[n]], keys[1][y[n]]
                found = (exact[n], *sorted((p, q)))
                if p != q and (best is None or found[0] > best[0] or (found[0] == best[0] and found[1:] < best[1:])):
                    best, least = found, max(least, float(squares[i[at + n], j[at + n]]))
    kind = here["key"].type
    d, x, y = ([v] for v in best) if best else ([], [], [])
    return pa.table([pa.array(x, kind), pa.array(y, kind), pa.array(d, pa.float64())], names=["a", "b", "distance"])


def farthest_pair(rows: DataFrame, group: list[str], key: str, vector: str) -> DataFrame:
    """group, a, b, distance: the two rows of each group that lie farthest apart, exactly; of equal pairs the first.

    With r the distance to the group's mean, two rows are at most r + r' apart. The row farthest from the mean and the
    one farthest from it give a distance that the answer has at least, so rows with r + max(r') below it drop out. What
    is left meets in cells of two parts of at most about BLOCK rows with about the same r, and cells that can't reach it
    aren't formed; copies of a vector meet once. A cell holds its two parts and a tile of distances. Groups of
    one row give none; rows without a finite vector take no part.
    """
    usable = _classes(rows, group, key, vector)
    placed = usable.join(_middle(usable, group), group).withColumn("r", distance(F.col("v"), F.col("_m"))).drop("_m", "n").transform(settled)
    first = _farthest(placed, group, "r").select(*group, F.col("v").alias("_f"), F.col("r").alias("_top"))
    second = placed.join(first, group).groupBy(*group).agg(F.max(distance(F.col("v"), F.col("_f"))).alias("_least"), F.max("_top").alias("_top"))
    # rounding of the bound
    low = F.col("_least") * (1 - 1e-9)
    left = placed.join(second, group).where(F.col("r") + F.col("_top") >= low)
    wide = left.groupBy(*group).agg(F.min("r").alias("_low"))
    # shells of equal width in r, each dealt into parts of about BLOCK rows
    shell = F.when(F.col("_top") > F.col("_low"), F.floor((F.col("_top") - F.col("r")) / (F.col("_top") - F.col("_low")) * 8)).otherwise(0)
    left = left.join(wide, group).withColumn("shell", shell).drop("_low")
    sizes = left.groupBy(*group, "shell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    left = left.join(sizes, [*group, "shell"]).withColumn("block", F.struct("shell", F.pmod(F.xxhash64("key"), F.col("_parts")).alias("part"))).transform(settled)
    blocks = left.groupBy(*group, "block.shell", "block.part").agg(F.max("r").alias("reach"))
    blocks = blocks.select(*group, F.struct("shell", "part").alias("block"), "reach").transform(settled)
    names = blocks.groupBy(*group).agg(F.collect_list(F.struct("block", "reach")).alias("_all"))  # one a part
    known = left.join(blocks, [*group, "block"]).join(names, group)
    reached = lambda o: o["reach"] + F.col("reach") >= low
    here = known.withColumn("to", F.explode(F.filter("_all", lambda o: (o["block"] >= F.col("block")) & reached(o))))
    there = known.withColumn("to", F.explode(F.filter("_all", lambda o: (o["block"] <= F.col("block")) & reached(o))))
    here = here.select(*group, "key", "v", F.col("block").alias("_i"), F.col("to.block").alias("_j"))
    there = there.select(*group, "key", "v", F.col("to.block").alias("_i"), F.col("block").alias("_j"))
    kind = usable.schema["key"].dataType.simpleString()
    found = _met(*[d.withColumns({c: F.to_json(c) for c in ("_i", "_j")}) for d in (here, there)], group, _best_pair, f"a {kind}, b {kind}, distance double")
    found = found.groupBy(*group).agg(F.min_by(F.struct("a", "b", "distance"), F.struct(-F.col("distance"), F.col("a"), F.col("b"))).alias("m")).select(*group, "m.*").where("distance > 0").transform(settled)
    # where all lie in one place, the first two rows
    rest = _usable(rows, group, key, vector).select(*group, "key").join(found.select(*group), group, "left_anti")
    one = rest.groupBy(*group).agg(F.min("key").alias("a"))
    two = rest.join(one, group).where("key != a").groupBy(*group, "a").agg(F.min("key").alias("b"))
    return found.unionByName(two.select(*group, "a", "b", F.lit(0.0).alias("distance")))


def split_by_farthest(rows: DataFrame, group: list[str], key: str, vector: str, primary: str | None = None) -> DataFrame:
    """group, key, side, apart: 1 for rows at least as near to the first of the farthest pair as to the second, else 2.

    ``apart`` is the distance of that pair. With ``primary`` (a boolean column) the side that holds the group's first
    primary row is side 1. Groups of one row have side 1 and a distance of 0.
    """
    usable = _usable(rows, group, key, vector)
    pair = farthest_pair(rows, group, key, vector)
    ends = [usable.toDF(*group, c, f"v{c}") for c in "ab"]
    pair = pair.join(ends[0], [*group, "a"]).join(ends[1], [*group, "b"]).select(*group, "va", "vb", "distance").transform(settled)
    nearer = distance(F.col("v"), F.col("va")) <= distance(F.col("v"), F.col("vb"))
    out = usable.join(pair, group, "left").select(*group, F.col("key").alias(key), F.when(F.coalesce(nearer, F.lit(True)), 1).otherwise(2).alias("side"), F.coalesce("distance", F.lit(0.0)).alias("apart"))
    if primary is None:
        return out
    out = out.transform(settled)
    marked = rows.where(F.col(primary)).select(*group, key).join(out, [*group, key]).groupBy(*group).agg(F.min_by("side", key).alias("_home"))
    turned = F.when(F.col("_home") == 2, 3 - F.col("side")).otherwise(F.col("side"))
    return out.join(marked, group, "left").select(*group, key, turned.alias("side"), "apart")


def _sums(exact: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The sum of the distances of each row here to all rows there."""

    def run(here: pa.Table, there: pa.Table) -> pa.Table:
        a, b, n = _matrix(here), _matrix(there), there["n"].to_numpy()
        middle, total = b.mean(0), np.zeros(len(a))
        if not exact:
            a, b = a - middle, b - middle
        for rows, columns in _tiles(len(a), len(b)):
            far = _direct(a[rows], b[columns]) if exact else np.sqrt(_squares(a[rows], b[columns]))
            total[rows] += far @ n[columns]
        return pa.table([here["key"], pa.array(total)], names=["key", "sum"])

    return run


def _bounds(here: pa.Table, there: pa.Table) -> pa.Table:
    """The largest bound of each row here by the rows there, whose means are known."""
    a, b, mean = _matrix(here), _matrix(there), there["mean"].to_numpy()
    bound = np.zeros(len(a))
    for rows, columns in _tiles(len(a), len(b)):
        bound[rows] = np.maximum(bound[rows], np.abs(mean[columns] - _direct(a[rows], b[columns])).max(1))
    return pa.table([here["key"], pa.array(bound)], names=["key", "bound"])


def _means(asked: DataFrame, usable: DataFrame, total: DataFrame, group: list[str], exact: bool) -> DataFrame:
    """group, key, mean of the rows ``asked``."""
    kind = usable.schema["key"].dataType.simpleString()
    found = _met(*_dealt(asked.select(*group, "key", "v"), usable, group), group, _sums(exact), f"key {kind}, sum double")
    found = found.groupBy(*group, "key").agg(F.sum("sum").alias("sum")).join(total, group)
    return found.select(*group, "key", (F.col("sum") / F.col("_n")).alias("mean")).transform(settled)


def medoids(rows: DataFrame, group: list[str], key: str, vector: str) -> DataFrame:
    """group, key, v, mean: the row of each group with the least mean distance to all its rows, of equal ones the first.

    Means that agree to 12 digits after the point are equal. A row's mean is at least |mean of another - distance to it|:
    the ASKED rows nearest to the middle bound all others, and what can't be least drops out. Means of what is left
    come from products of vectors, in cells of two parts; only rows within their rounding of the least are
    added up from the differences. Copies of a vector count as one row of that weight. Where bounds don't hold rows
    off, this is all pairs, a tile at a time.
    """
    usable = _classes(rows, group, key, vector)
    total = usable.groupBy(*group).agg(F.sum("n").alias("_n")).transform(settled)
    kind = usable.schema["key"].dataType.simpleString()
    placed = usable.join(_middle(usable, group), group).withColumn("r", distance(F.col("v"), F.col("_m"))).drop("_m").transform(settled)
    asked = placed.select(*group, "key", "r").withColumn("_at", place(group, F.asc("r"), F.asc("key"))).where(F.col("_at") <= ASKED).select(*group, "key")
    asked = usable.join(asked, [*group, "key"]).transform(settled)
    means = _means(asked, usable, total, group, True)
    best = means.groupBy(*group).agg(F.min("mean").alias("_best")).transform(settled)
    waiting = usable.join(asked.select(*group, "key"), [*group, "key"], "left_anti").select(*group, "key", "v")
    bounds = _met(*_dealt(waiting, asked.join(means, [*group, "key"]), group), group, _bounds, f"key {kind}, bound double")
    bounds = bounds.groupBy(*group, "key").agg(F.max("bound").alias("bound")).join(best, group).where(F.col("bound") * (1 - 1e-9) <= F.col("_best") + 1e-12)
    left = usable.join(bounds.select(*group, "key"), [*group, "key"]).transform(settled)
    rough = _means(left, usable, total, group, False)
    least = rough.groupBy(*group).agg(F.min("mean").alias("_rough")).join(best, group)
    # twice the rounding of a distance by products
    off = placed.groupBy(*group).agg((F.max("r") * 4e-6 + 1e-12).alias("_off"))
    close = rough.join(least, group).join(off, group).where(F.col("mean") <= F.least("_rough", "_best") + F.col("_off"))
    means = means.unionByName(_means(usable.join(close.select(*group, "key"), [*group, "key"]).transform(settled), usable, total, group, True))
    first = means.groupBy(*group).agg(F.min(F.struct(F.round("mean", 12).alias("mean"), "key")).alias("m")).select(*group, F.col("m.key").alias("key"))
    return usable.join(first, [*group, "key"]).join(means, [*group, "key"]).select(*group, F.col("key").alias(key), "v", "mean")


def farthest_points(rows: DataFrame, group: list[str], key: str, vector: str, k: int) -> DataFrame:
    """group, rank, key, apart: the medoid, then in turn the row farthest from all picked so far (of equal ones the first).

    Each row carries its least distance to the picks, so a round looks at one new pick a group. ``apart`` is the
    distance to the nearest of all other picks, NULL for a single one.
    """
    usable = _usable(rows, group, key, vector).withColumn("least", F.lit(float("inf"))).transform(settled)
    pick = medoids(rows, group, key, vector).select(*group, F.col(key).alias("_p"), F.col("v").alias("_v")).transform(settled)
    picks = [pick.withColumn("rank", F.lit(1))]
    for rank in range(2, k + 1):
        usable = usable.join(pick, group).where("key != _p").withColumn("least", F.least("least", distance(F.col("v"), F.col("_v")))).drop("_p", "_v").transform(settled)
        pick = _farthest(usable, group, "least").select(*group, F.col("key").alias("_p"), F.col("v").alias("_v")).transform(settled)
        if not pick.take(1):
            break
        picks.append(pick.withColumn("rank", F.lit(rank)))
    out = picks[0]
    for more in picks[1:]:
        out = out.unionByName(more)
    out = out.transform(settled)  # k rows a group
    other = out.select(*group, F.col("_v").alias("_w"), F.col("rank").alias("_rank"))
    apart = out.join(other, group).where("rank != _rank").groupBy(*group, "rank").agg(F.min(distance(F.col("_v"), F.col("_w"))).alias("apart"))
    return out.join(apart, [*group, "rank"], "left").select(*group, "rank", F.col("_p").alias(key), "apart")
