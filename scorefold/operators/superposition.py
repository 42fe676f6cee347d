"""Superposition and pairing of structures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import place


def superposed_rmsd(pairs: DataFrame, group: list[str], p: list[str], q: list[str]) -> DataFrame:
    """group, n, rmsd: the least root mean square distance of paired points over all rotations and shifts.

    It follows from the covariances of the coordinates alone: the singular values of their 3 x 3 matrix, the
    least one negative where the best fit would mirror, are roots of the eigenvalues of a symmetric matrix,
    which have a closed form. So each group needs one aggregation with partial sums and no array of points.
    """
    whole = pairs.where(" AND ".join(f"{c} IS NOT NULL" for c in [*p, *q]))
    covariances = {f"h{i}{j}": F.covar_pop(a, b) for i, a in enumerate(p) for j, b in enumerate(q)}
    power = sum((F.var_pop(c) for c in [*p[1:], *q]), F.var_pop(p[0]))
    sums = whole.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), power.alias("power"), *[c.alias(n) for n, c in covariances.items()])
    h = [[F.col(f"h{i}{j}") for j in range(3)] for i in range(3)]
    m = {f"m{i}{j}": h[0][i] * h[0][j] + h[1][i] * h[1][j] + h[2][i] * h[2][j] for i in range(3) for j in range(i, 3)}
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    sums = sums.withColumns({**m, "side": F.signum(det(h))}).withColumn("mid", (F.col("m00") + F.col("m11") + F.col("m22")) / 3)
    off = F.col("m01") * F.col("m01") + F.col("m02") * F.col("m02") + F.col("m12") * F.col("m12")
    d = [F.col(f"m{i}{i}") - F.col("mid") for i in range(3)]
    sums = sums.withColumn("wide", F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * off) / 6))
    b = [[d[0], F.col("m01"), F.col("m02")], [F.col("m01"), d[1], F.col("m12")], [F.col("m02"), F.col("m12"), d[2]]]
    turn = F.when(F.col("wide") > 0, det(b) / (2 * F.col("wide") * F.col("wide") * F.col("wide"))).otherwise(0.0)
    sums = sums.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), turn))) / 3)
    high = F.col("mid") + 2 * F.col("wide") * F.cos("angle")
    low = F.col("mid") + 2 * F.col("wide") * F.cos(F.col("angle") + F.lit(2.0943951023931953))
    sums = sums.withColumns({"high": high, "low": low})
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    fit = root(F.col("high")) + root(3 * F.col("mid") - F.col("high") - F.col("low")) + F.when(F.col("side") < 0, -1).otherwise(1) * root(F.col("low"))
    return sums.select(*group, "n", F.round(root(F.col("power") - 2 * fit), 6).alias("rmsd"))


FRAME = [f"r{i}{j}" for i in range(3) for j in range(3)] + [f"t{i}" for i in range(3)]


def frames(pairs: DataFrame, group: list[str], p: list[str], q: list[str]) -> DataFrame:
    """group, n and the best rigid motion q = r p + t of paired points: rotation r00 to r22, shift t0 to t2.

    The rotation is the quaternion of the largest eigenvalue of a symmetric 4 x 4 matrix of the covariances, so it
    never mirrors. One aggregation gives the matrix; eigenvectors are taken for a batch of groups at a time. Points on
    a line or in one place have several best rotations, of which one is given; pairs with a NULL take no part.
    """
    whole = pairs.where(" AND ".join(f"{c} IS NOT NULL" for c in [*p, *q]))
    parts = {f"h{i}{j}": F.covar_pop(a, b) for i, a in enumerate(p) for j, b in enumerate(q)}
    means = {f"m{side}{i}": F.avg(c) for side, axes in (("p", p), ("q", q)) for i, c in enumerate(axes)}
    sums = whole.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (parts | means).items()])
    matrix = list(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            h = np.stack([column(k) for k in matrix], -1).reshape(-1, 3, 3)
            m = [np.stack([column(f"m{side}{i}") for i in range(3)], -1) for side in "pq"]
            turned = h - h.transpose(0, 2, 1)
            k = np.empty((len(h), 4, 4))
            k[:, 0, 0] = np.trace(h, axis1=1, axis2=2)
            k[:, 0, 1:] = k[:, 1:, 0] = np.stack([turned[:, 1, 2], turned[:, 2, 0], turned[:, 0, 1]], -1)
            k[:, 1:, 1:] = h + h.transpose(0, 2, 1) - k[:, :1, :1] * np.eye(3)
            w, x, y, z = np.linalg.eigh(k)[1][:, :, -1].T
            r = np.stack(
                [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], -1
            )
            t = m[1] - np.einsum("nij,nj->ni", r.reshape(-1, 3, 3), m[0])
            columns = [batch.column(c) for c in (*group, "n")] + [pa.array(v) for v in (*r.T, *t.T)]
            yield pa.RecordBatch.from_arrays(columns, names=[*group, "n", *FRAME])

    kept = sums.select(*group, "n").schema
    return sums.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields], *[f"{c} double" for c in FRAME]]))


def moved(points: DataFrame, motions: DataFrame, group: list[str], axes: list[str]) -> DataFrame:
    """Points of the groups that have a motion, moved by it."""
    shift = lambda i: sum((F.col(f"r{i}{j}") * F.col(axes[j]) for j in range(3)), F.col(f"t{i}"))
    return points.join(motions.select(*group, *FRAME), group).select(*[shift(axes.index(c)).alias(c) if c in axes else c for c in points.columns])


def positional_rmsd(predicted: DataFrame, reference: DataFrame, group: list[str], residue: list[str], order: list[Column], axes: list[str]) -> DataFrame:
    """group, n, rmsd of atoms with the same residue, the first in order of each side; rmsd is NULL where none is shared."""
    first = lambda side: side.withColumn("_at", place([*group, *residue], *order)).where("_at = 1")
    a = first(predicted).select(*group, *residue, *axes)
    b = first(reference).select(*group, *residue, *[F.col(c).alias(f"_{c}") for c in axes])
    square = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in axes[1:]), (F.col(axes[0]) - F.col(f"_{axes[0]}")) * (F.col(axes[0]) - F.col(f"_{axes[0]}")))
    found = a.join(b, [*group, *residue]).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(square)), 6).alias("rmsd"))
    return predicted.select(*group).distinct().join(found, group, "left").select(*group, F.coalesce("n", F.lit(0)).alias("n"), "rmsd")


def best_offset(reference: Column, predicted: Column, least: int = 1) -> Column:
    """offset and matches: the shift of ``reference`` at which most letters equal those of ``predicted``, the first of equal ones; 0 where fewer than ``least`` match."""
    letters = lambda s, at: F.substr(s, at + 1, F.lit(1))
    places = F.sequence(F.lit(0), F.length(reference) - 1)

    def matches(offset: Column) -> Column:
        equal = F.filter(places, lambda i: (i + offset >= 0) & (i + offset < F.length(predicted)) & (letters(reference, i) == letters(predicted, i + offset)))
        return F.struct(F.size(equal).alias("matches"), (-offset).alias("back"))

    best = F.array_max(F.transform(F.sequence(1 - F.length(reference), F.length(predicted) - 1), matches))
    some = (F.length(reference) > 0) & (F.length(predicted) > 0)
    found = F.when(some, best)
    hit = F.coalesce(found["matches"], F.lit(0))
    return F.struct(F.when((hit > 0) & (hit >= least), -found["back"]).otherwise(0).alias("offset"), hit.alias("matches"))


#: Strings of up to so many letters are slid within their row.
LONG = 1024


def _codes(texts: list[str], pad: int, before: int = 0, after: int = 0) -> np.ndarray:
    """The code points of each string in a row, ``pad`` around them."""
    lengths = np.array([len(t) for t in texts])
    wide = max(int(lengths.max()), 1)
    out = np.array(texts, dtype=f"<U{wide}").view(np.uint32).reshape(len(texts), wide).copy()
    out[np.arange(wide) >= lengths[:, None]] = pad
    return np.pad(out, ((0, 0), (before, after)), constant_values=pad)


def slid(references: list[str], predicted: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The offset with most matches of each pair, the first of equal ones, and its matches; 0 and 0 without any."""
    offset, matches = np.zeros(len(references), np.int32), np.zeros(len(references), np.int32)
    order = np.argsort([max(len(r), len(p)) for r, p in zip(references, predicted, strict=True)], kind="stable")
    for at in range(0, len(order), 512):
        rows = order[at : at + 512]
        a = _codes([references[i] for i in rows], 1 << 30)
        wide = a.shape[1]
        b = _codes([predicted[i] for i in rows], 1 << 31, wide - 1, wide - 1)
        best, by = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for shift in range(b.shape[1] - wide + 1):
            equal = (a == b[:, shift : shift + wide]).sum(1, dtype=np.int32)
            better = equal > best
            best[better], by[better] = equal[better], shift - wide + 1
        offset[rows], matches[rows] = by, best
    return offset, matches


def _letters(rows: DataFrame, key: list[str], text: str, at: str, *more: Column) -> DataFrame:
    return rows.select(*key, F.posexplode(F.split(text, "")).alias(at, "_letter"), *more).where("_letter != ''")


def offsets(pairs: DataFrame, key: list[str], reference: str, predicted: str, least: int = 1) -> DataFrame:
    """key, offset, matches of each pair of strings, as ``best_offset`` gives them.

    Pairs of up to LONG letters are slid along each other within their row, many rows at a time. Longer ones are taken
    apart: letters meet where they are equal, so a shift's matches are a count and shifts without any are never looked at.
    """
    rows = pairs.select(*key, F.coalesce(reference, F.lit("")).alias("_r"), F.coalesce(predicted, F.lit("")).alias("_p"))
    long = F.greatest(F.length("_r"), F.length("_p")) > LONG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = slid(batch.column("_r").to_pylist(), batch.column("_p").to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *map(pa.array, found)], names=[*key, "offset", "matches"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema.fields], "offset int, matches int"])
    near = rows.where(~long).repartition(*key).mapInArrow(run, schema)  # a small file is one split
    rest = rows.where(long)
    counted = _letters(rest, key, "_r", "_i").join(_letters(rest, key, "_p", "_j"), [*key, "_letter"]).groupBy(*key, (F.col("_j") - F.col("_i")).alias("offset")).agg(F.count(F.lit(1)).cast("int").alias("matches"))
    best = counted.groupBy(*key).agg(F.min(F.struct(-F.col("matches"), F.col("offset"))).alias("m")).select(*key, F.col("m.offset").alias("offset"), (-F.col("m.col1")).alias("matches"))
    found = near.unionByName(rest.select(*key).join(best, key, "left"))
    return found.select(*key, F.when(F.col("matches") >= least, F.col("offset")).otherwise(0).alias("offset"), F.coalesce("matches", F.lit(0)).alias("matches"))


SUMS = ["n", *[f"{s}{i}" for s in "pq" for i in range(3)], *[f"h{i}{j}" for i in range(3) for j in range(3)], "square"]
#: Assignments of chains that are fitted at once.
ASSIGNED = 20_000


def assemblies(first: DataFrame, second: DataFrame, group: list[str], chain: str, residue: str) -> DataFrame:
    """group, chains, rmsd: the least root mean square distance of two structures over all assignments of their chains.

    Rows of both sides are residues with x, y, z; chains meet by their shared residues. The fit of an assignment follows
    from sums over its pairs of chains, so points are added up once for each pair of chains and an assignment is a sum of
    few numbers. All assignments are tried, in blocks. Groups with other numbers of chains on the two sides, or without
    a shared residue in any assignment, have a NULL rmsd.
    """
    rows = []
    for side, name in ((first, "p"), (second, "q")):
        whole = side.where(" AND ".join(f"abs({a}) < double('infinity')" for a in "xyz"))
        middle = whole.groupBy(*group).agg(*[F.avg(a).alias(f"_{a}") for a in "xyz"])
        # near the middle, so that sums of squares keep their digits
        rows.append(whole.join(middle, group).select(*group, F.col(chain).alias(f"c{name}"), F.col(residue).alias("r"), *[(F.col(a) - F.col(f"_{a}")).alias(f"{name}{i}") for i, a in enumerate("xyz")]))
    chains = [d.groupBy(*group).agg(F.array_sort(F.collect_set(c)).alias(f"all_{c}")) for d, c in zip(rows, ("cp", "cq"), strict=True)]
    met = rows[0].join(rows[1], [*group, "r"])
    square = sum((F.col(c) * F.col(c) for c in ("p1", "p2", "q0", "q1", "q2")), F.col("p0") * F.col("p0"))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"{s}{i}").alias(f"{s}{i}") for s in "pq" for i in range(3)]]
    sums += [F.sum(F.col(f"p{i}") * F.col(f"q{j}")).alias(f"h{i}{j}") for i in range(3) for j in range(3)] + [F.sum(square).alias("square")]
    between = met.groupBy(*group, "cp", "cq").agg(*sums)
    # a row for each pair of chains
    table = between.groupBy(*group).agg(F.collect_list(F.struct("cp", "cq", F.array(*SUMS).alias("v"))).alias("pairs"))
    known = chains[0].join(chains[1], group).join(table, group, "left")
    names = known.select(*group).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = row["all_cp"], row["all_cq"]
                best = None
                if len(a) == len(b):
                    v = np.zeros((len(a), len(b), len(SUMS)))
                    for m in row["pairs"] or []:
                        v[a.index(m["cp"]), b.index(m["cq"])] = m["v"]
                    tried = permutations(range(len(b)))
                    while block := list(islice(tried, ASSIGNED)):
                        value = fitted(v[np.arange(len(a)), np.array(block)].sum(1))
                        if len(value) and (best is None or value.min() < best):
                            best = float(value.min())
                out.append({g: row[g] for g in group} | {"chains": len(a), "rmsd": best})
            if out:
                fields = [batch.schema.field(g) for g in group]
                yield pa.RecordBatch.from_pylist(out, pa.schema([*fields, ("chains", pa.int32()), ("rmsd", pa.float64())]))

    return known.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in names.fields], "chains int, rmsd double"]))


def fitted(sums: np.ndarray) -> np.ndarray:
    """Least root mean square distances from rows of SUMS; rows without points are left out."""
    sums = sums[sums[:, 0] > 0]
    n, p, q = sums[:, :1], sums[:, 1:4], sums[:, 4:7]
    h = sums[:, 7:16].reshape(-1, 3, 3) - p[:, :, None] * q[:, None, :] / n[:, :, None]
    power = sums[:, 16] - ((p * p).sum(1) + (q * q).sum(1)) / n[:, 0]
    single = np.linalg.svd(h, compute_uv=False)
    single[:, 2] *= np.where(np.linalg.det(h) < 0, -1, 1)
    return np.sqrt(np.maximum(power - 2 * single.sum(1), 0) / n[:, 0])


def matched_pairs(a: DataFrame, b: DataFrame, key: list[str], sequence: str, offset: Column) -> DataFrame:
    """key, i, j, letter: positions of ``a`` and ``b`` (``offset`` further on) whose letters agree.

    Whole strings meet by key. What of the other one lies beside a string of up to LONG letters is compared within the row;
    the letters of longer strings are rows, which meet by position.
    """
    rows = a.select(*key, F.col(sequence).alias("_a"), offset.cast("int").alias("_by"))
    low = F.greatest(F.lit(0), -F.col("_by"))
    met = rows.where(F.length("_a") <= LONG).join(b.select(*key, F.col(sequence).alias("_b")), key)
    met = met.withColumns({"_low": low, "_n": F.least(F.length("_a"), F.length("_b") - F.col("_by")) - low}).where("_n > 0")
    cut = lambda text, at: F.filter(F.split(F.substr(text, at + 1, F.col("_n")), ""), lambda x: x != "")
    met = met.select(*key, "_by", "_low", cut(F.col("_a"), F.col("_low")).alias("_a"), cut(F.col("_b"), F.col("_low") + F.col("_by")).alias("_b"))
    pair = lambda x, n: F.struct((n + F.col("_low")).alias("i"), (n + F.col("_low") + F.col("_by")).alias("j"), x.alias("letter"), (x == F.get("_b", n)).alias("same"))
    near = met.select(*key, F.inline(F.filter(F.transform("_a", pair), lambda x: x["same"]))).select(*key, "i", "j", "letter")
    rest = _letters(rows.where(F.length("_a") > LONG), key, "_a", "i", "_by").withColumn("j", F.col("i") + F.col("_by")).drop("_by")
    far = rest.join(_letters(b, key, sequence, "j"), [*key, "j", "_letter"]).select(*key, "i", "j", F.col("_letter").alias("letter"))
    return near.unionByName(far)
