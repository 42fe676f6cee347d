"""Neighbours, clusters and density of 3-D points within groups.

Pairs come from a grid of cells as wide as the radius: a point meets the points of its own and the
adjoining cells only, an equi-join on (group, cell), never a cross join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .lineage import settled

AXES = ("x", "y", "z")
#: So many links at most are joined by one task.
SMALL = 100_000
#: So many pairs of points of two boxes at most are compared without halving the boxes.
PAIRS = 1024
#: Edge of a box over the radius: the diagonal stays under the radius, and two edges over it whatever rounding does.
HALF = 0.501
#: So many edges from zero at most, rounding moves a point by far less than what HALF leaves.
FAR = float(2**40)


def _at(axis: str, edge: float) -> Column:
    """The cell of a grid that a coordinate is in; NULL, which meets none, of those that aren't finite, and one for all beyond 10^18."""
    at = F.col(axis) / edge
    return F.when(F.abs(at) < float("inf"), F.floor(F.greatest(F.least(at, F.lit(1e18)), F.lit(-1e18))))


def neighbours(points: DataFrame, group: list[str], key: str, radius: float, strict: bool = False) -> DataFrame:
    """group, a, b (a < b), distance of all pairs within ``radius``."""
    cells = points.select(*group, key, *AXES, *[_at(c, radius).alias(f"c{c}") for c in AXES])
    around = cells.select(*group, F.col(key).alias("b"), *[F.col(c).alias(f"{c}2") for c in AXES], *[F.col(f"c{c}") for c in AXES])
    for c in AXES:
        around = around.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    squares = sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in AXES)
    near = F.sqrt(squares) < radius if strict else F.sqrt(squares) <= radius
    joined = cells.join(around, [*group, *[f"c{c}" for c in AXES]]).where((F.col(key) < F.col("b")) & near)
    return joined.select(*group, F.col(key).alias("a"), "b", F.sqrt(squares).alias("distance"))


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that links (a, b) lead to.

    In a round every node goes to its least neighbour, if that is less than itself, and on to where that one goes;
    links are drawn anew between what is left, so they become fewer. The least id of a component never moves. Once
    at most SMALL links are left, one task settles them.
    """
    left, moves = links.select("a", "b").where("a != b").distinct().transform(settled), []
    while left.count() > SMALL:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")).transform(settled)
        on = to.join(to.toDF("to", "further"), "to").select("node", F.col("further").alias("to")).transform(settled)
        moves.append(on)
        moved = left.join(on.toDF("a", "_a"), "a").join(on.toDF("b", "_b"), "b").where("_a != _b")
        left = moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().transform(settled)
    moves.append(left.coalesce(1).mapInArrow(_joined(to_arrow_schema(left.schema)), left.schema).toDF("node", "to"))
    labels = ids.select("id", F.col("id").alias("label"))
    for to in moves:
        labels = labels.join(to.toDF("label", "_to"), "label", "left").select("id", F.coalesce("_to", "label").alias("label"))
    return labels.transform(settled)


def in_order(value: object) -> tuple:
    """A key that orders a value of a column as Spark does: NULL first, structs by their fields."""
    if value is None:
        return (False,)
    return (True, tuple(map(in_order, value.values())) if isinstance(value, dict) else value)


def _joined(schema: pa.Schema):
    """(node, least node of its component) of at most SMALL links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, value = {}, {}

        def root(x: tuple) -> tuple:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for link in batch.to_pylist():
                ends = []
                for v in link.values():
                    k = in_order(v)
                    value[k] = v
                    ends.append(root(up.setdefault(k, k) and k))
                up[max(ends)] = min(ends)
        a, b = schema.names
        yield pa.RecordBatch.from_pylist([{a: value[k], b: value[root(k)]} for k in up], schema)

    return run


def parts(points: DataFrame, group: list[str], edge: float, out: str = "_part") -> DataFrame:
    """Adds a part such that points of different parts of a group lie more than ``edge`` apart along some axis.

    Cells as wide as ``edge`` are cut wherever an axis has an empty cell between two occupied ones, again within each
    part until nothing more comes apart. Only distinct cells of an axis are ordered, as many as its extent has.
    """
    cells = points.withColumns({out: F.lit(""), **{f"_c{a}": F.floor(F.col(a) / edge) for a in AXES}}).transform(settled)
    before = 0
    while True:
        at = Window.partitionBy(*group, out).orderBy("_c")
        runs = cells
        for a in AXES:
            seen = cells.select(*group, out, F.col(f"_c{a}").alias("_c")).distinct()
            gap = F.coalesce((F.col("_c") - F.lag("_c").over(at) > 1).cast("int"), F.lit(0))
            numbered = seen.withColumn("_gap", gap).withColumn(f"_r{a}", F.sum("_gap").over(at))
            numbered = numbered.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*group, out, "_c"))], f"_r{a}")
            same = F.lit(True)
            for i, c in enumerate((*group, out, f"_c{a}")):
                same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
            runs = runs.join(numbered, same).drop(*[f"_k{i}" for i in range(len(group) + 2)])
        cells = runs.withColumn(out, F.concat_ws(".", out, *[f"_r{a}" for a in AXES])).select(*cells.columns).transform(settled)
        after = cells.select(*group, out).distinct().count()
        if after == before:
            return cells.drop(*[f"_c{a}" for a in AXES])
        before = after


def whole_key(group: list[str], key: str) -> Column:
    """Tells points apart where keys recur between groups; points of a group are ordered by key."""
    return F.struct(*[F.col(g) for g in group], F.col(key).alias("_key"))


def single_link(points: DataFrame, group: list[str], key: str, radius: float, strict: bool = False) -> DataFrame:
    """Every point with the cluster it is in, named by its smallest key; keys may recur between groups.

    The points of a box of about half the radius are linked anyway, so boxes are joined in place of points: first those
    whose first points are near, then, of different clusters only, those that any two points link. So pairs
    are of boxes, at most 216 a box, however many points a box holds. A point that has no box is one by itself. Within a
    radius of 0 are copies only, which make a box.
    """
    edge, boxed = radius * HALF, F.lit(radius > 0 or (radius == 0 and not strict))
    for c in [*[F.col(g).isNotNull() for g in group], *[F.coalesce(_within(c, edge), F.lit(False)) for c in AXES]]:
        boxed = boxed & c
    marked = points.withColumn("_id", whole_key(group, key))
    cell = [(_at(c, edge) if edge > 0 else F.col(c)).alias(f"c{c}") for c in AXES]
    marked = marked.withColumn("_box", F.struct(*[F.col(g) for g in group], *cell, F.when(~boxed, F.col("_id")).alias("_alone")))
    boxes = marked.groupBy("_box").agg(*_bounds()).transform(settled)
    labels = boxes.select("id", F.col("id").alias("label"))
    if edge > 0:
        first = boxes.select(*[F.col(f"_box.{g}").alias(g) for g in group], "id", "at.*")
        labels = components(boxes.select("id"), neighbours(first, group, "id", radius, strict))
        labels = _linked(marked.select("_box", "_id", *AXES), boxes, labels, group, radius, strict)
    named = boxes.join(labels, "id").select("_box", F.col("label").alias("_label"))
    return marked.join(named, "_box").select(*points.columns, F.col("_label._key").alias("cluster"))


def _within(axis: str, edge: float) -> Column:
    """Whether boxes of a coordinate hold near points only."""
    return F.abs(F.col(axis) / edge) < FAR if edge > 0 else F.abs(axis) < float("inf")


def _bounds() -> list[Column]:
    """Of a box of rows (_id, x, y, z): the least _id as id, the point that has it, the number of rows and the edges."""
    edges = [f(c).alias(f"{side}{c}") for side, f in (("low_", F.min), ("high_", F.max)) for c in AXES]
    return [F.min("_id").alias("id"), F.min_by(F.struct(*AXES), "_id").alias("at"), F.count(F.lit(1)).alias("n"), *edges]


def _length(sides: list[Column]) -> Column:
    return F.sqrt(sum(side**2 for side in sides))


def _linked(points: DataFrame, boxes: DataFrame, labels: DataFrame, group: list[str], radius: float, strict: bool) -> DataFrame:
    """``labels`` of ``boxes``, joined further where any two ``points`` of two boxes of different labels are near.

    In a round the points of two boxes meet if they make PAIRS pairs at most. Other boxes are halved along each axis, and only
    halves go on that may hold a near pair; two of them are linked once their farthest or their first points are near.
    Subtractions and sums of squares keep their order when rounded, so edges bound the distances of points exactly.
    """
    within = (lambda c: c < radius) if strict else (lambda c: c <= radius)
    least = within(_length([F.greatest(F.col(f"b.low_{c}") - F.col(f"a.high_{c}"), F.col(f"a.low_{c}") - F.col(f"b.high_{c}"), F.lit(0.0)) for c in AXES]))
    most = within(_length([F.greatest(F.col(f"b.high_{c}") - F.col(f"a.low_{c}"), F.col(f"a.high_{c}") - F.col(f"b.low_{c}")) for c in AXES]))
    firsts = within(_length([F.col(f"a.at.{c}") - F.col(f"b.at.{c}") for c in AXES]))
    ends = [F.col("a.id").alias("a"), F.col("b.id").alias("b")]

    wide = F.lit(False)
    for c in AXES:
        wide = wide | (F.col(f"low_{c}") < F.col(f"high_{c}"))
    known = boxes.join(labels, "id").withColumn("wide", wide)
    for g in group:
        known = known.withColumn(f"_g_{g}", F.col(f"_box.{g}"))
    for c in AXES:
        known = known.withColumn(f"_k_{c}", F.shiftright(f"_box.c{c}", 1))
    around = known.where("wide")
    for c in AXES:
        around = around.withColumn(f"_k_{c}", F.explode(F.array(*[F.col(f"_k_{c}") + d for d in (-1, 0, 1)])))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*[f"_g_{g}" for g in group], *[f"_k_{c}" for c in AXES]]]
    apart = F.col("a.label") != F.col("b.label")
    once = ~F.col("b.wide") | (F.col("a.id") < F.col("b.id"))
    left = around.alias("a").join(known.alias("b"), same).where(apart & once & least)
    size = (F.col("a.n") * F.col("b.n")).alias("size")
    left = left.select(*ends, F.col("a.label").alias("la"), F.col("b.label").alias("lb"), size).transform(settled)
    held = points.join(boxes.select("_box", F.col("id").alias("box")), "_box").select("box", "_id", *AXES)
    while left.take(1):
        few, many = left.where(F.col("size") <= PAIRS), left.where(F.col("size") > PAIRS)
        a, b = held.alias("a"), held.alias("b")
        met = few.join(a, F.col("a.box") == few["a"]).join(b, F.col("b.box") == few["b"])
        near = met.where(within(_length([F.col(f"a.{c}") - F.col(f"b.{c}") for c in AXES])))
        found = near.select("la", "lb").distinct()
        divided = bool(many.take(1))
        if divided:
            halves, held = _halved(held, many.select(F.explode(F.array("a", "b")).alias("box")).distinct())
            a, b = halves.alias("a"), halves.alias("b")
            met = many.drop("size").join(a, F.col("a.box") == many["a"]).join(b, F.col("b.box") == many["b"]).where(least)
            met = met.select(*ends, "la", "lb", size, (most | firsts).alias("near")).transform(settled)
            found = found.unionByName(met.where("near").select("la", "lb")).distinct()
            left = met.where("NOT near").drop("near")
        found = found.transform(settled)
        if found.take(1):
            moved = components(found.select(F.explode(F.array("la", "lb")).alias("id")).distinct(), found.toDF("a", "b"))
            labels = labels.join(moved.toDF("label", "_to"), "label", "left").select("id", F.coalesce("_to", "label").alias("label")).transform(settled)
            for end in ("la", "lb"):
                left = left.join(moved.toDF(end, "_to"), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        if not divided:
            break
        left = left.where("la != lb").select("a", "b", "la", "lb", "size").transform(settled)
    return labels


def _halved(held: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The halves along each axis of those ``boxes`` (box) that rows ``held`` (box, _id, x, y, z) are in, and the rows with the halves.

    The lowest and the highest row of an axis always part, so a box comes down to rows of one place.
    """
    rows = held.join(boxes, "box").transform(settled)
    edges = rows.groupBy("box").agg(*[f(c).alias(f"{side}{c}") for side, f in (("low_", F.min), ("high_", F.max)) for c in AXES])
    upper = [(F.col(c) - F.col(f"low_{c}") > F.col(f"high_{c}") - F.col(c)).alias(f"up_{c}") for c in AXES]
    rows = rows.join(edges, "box").select(F.struct("box", *upper).alias("half"), "_id", *AXES).transform(settled)
    halves = rows.groupBy("half").agg(*_bounds()).transform(settled)
    rows = rows.join(halves.select("half", "id"), "half").select(F.col("id").alias("box"), "_id", *AXES).transform(settled)
    return halves.withColumn("box", F.col("half.box")), rows


def cluster_summary(clustered: DataFrame, group: list[str], weight: str) -> DataFrame:
    """Size, weight and weighted centroid of clusters (the plain mean where all weights are 0)."""
    total = F.sum(weight)
    centre = [F.round(F.when(total != 0, F.sum(F.col(weight) * F.col(c)) / total).otherwise(F.avg(c)), 6).alias(f"centre_{c}") for c in AXES]
    return clustered.groupBy(*group, "cluster").agg(F.count(F.lit(1)).alias("size"), F.round(total, 6).alias("evidence"), *centre)


def support(points: DataFrame, group: list[str], key: str, family: str, radius: float) -> DataFrame:
    """Every point's number of neighbours of other families."""
    pairs = neighbours(points, group, key, radius, strict=True)
    kinds = points.select(*group, F.col(key).alias("_k"), F.col(family).alias("_f"))
    known = pairs.join(kinds.toDF(*group, "a", "fa"), [*group, "a"]).join(kinds.toDF(*group, "b", "fb"), [*group, "b"]).where("fa != fb")
    counted = known.select(*group, F.explode(F.array("a", "b")).alias(key)).groupBy(*group, key).agg(F.count(F.lit(1)).alias("support"))
    return points.select(*group, key).join(counted, [*group, key], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def density_mode(points: DataFrame, group: list[str], key: str, radius: float, least: int = 1) -> DataFrame:
    """Per group the point with most neighbours (itself counted) and the mean of its neighbourhood, where it has ``least`` or more."""
    pairs = neighbours(points, group, key, radius)
    ends = pairs.select(*group, F.col("a").alias(key), F.col("b").alias("n")).unionByName(pairs.select(*group, F.col("b").alias(key), F.col("a").alias("n")))
    ends = ends.unionByName(points.select(*group, key, F.col(key).alias("n")))
    counted = ends.groupBy(*group, key).agg(F.count(F.lit(1)).alias("neighbours"))
    best = counted.groupBy(*group).agg(F.max_by(key, F.struct("neighbours", -F.col(key))).alias(key), F.max("neighbours").alias("neighbours")).where(F.col("neighbours") >= least)
    around = ends.join(best, [*group, key]).join(points.select(*group, F.col(key).alias("n"), *AXES), [*group, "n"])
    return around.groupBy(*group, key, "neighbours").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in AXES])


def representatives(clustered: DataFrame, group: list[str], key: str, quality: Column) -> DataFrame:
    """group, cluster, size, key: the row of the least ``quality`` (of equal ones the first key, NULL last) of each cluster."""
    order = F.struct(quality.isNull(), quality, F.col(key))
    return clustered.groupBy(*group, "cluster").agg(F.count(F.lit(1)).alias("size"), F.min_by(key, order).alias(key))


def voxels(points: DataFrame, group: list[str], edge: float) -> DataFrame:
    """Points per cell of a grid whose cells are centred on multiples of ``edge``; halves go to the even cell."""
    cells = [F.bround(F.col(a) / edge).cast("bigint").alias(f"cell_{a}") for a in AXES]
    return points.groupBy(*group, *cells).agg(F.count(F.lit(1)).alias("n"))


def nearest(points: DataFrame, group: list[str], key: str, anchor: list[float]) -> DataFrame:
    """The point of each group that is closest to ``anchor``."""
    square = sum(((F.col(a) - F.lit(v)) * (F.col(a) - F.lit(v)) for a, v in zip(AXES[1:], anchor[1:], strict=True)), (F.col(AXES[0]) - anchor[0]) * (F.col(AXES[0]) - anchor[0]))
    found = points.groupBy(*group).agg(F.min(F.struct(square.alias("d"), F.col(key).alias("k"))).alias("m"))
    return found.select(*group, F.col("m.k").alias(key), F.round(F.sqrt("m.d"), 6).alias("distance"))
