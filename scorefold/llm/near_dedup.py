"""Near-duplicate detection by BagMinHash signatures of word-shingle multisets.

1. Texts with equal shingle multisets form a class; one representative of each goes on.
2. A representative's signature is sampled by BagMinHash: every shingle of weight w runs Poisson
   processes over the dyadic intervals (0, 1], (1, 2], (2, 4], ... of the discretised weight axis;
   a point above w is passed over. The first point of each register is kept, so two registers agree
   with the probability of the weighted Jaccard similarity.
3. Registers are banded; rows that share a band form a bucket, and buckets with equal members count once.
4. Buckets are cut into blocks of BLOCK members by a hash that differs per bucket. In each block the
   exact multiset overlap of all its members is computed in numpy and links that join them are
   emitted, a spanning forest of the pairs at or above the threshold, never all pairs.
5. Links become classes by minimum labels. The FIRST bands come first; of the other buckets only those
   that still hold several classes are compared. Where a bucket of several blocks still holds several
   classes, every member outside its most frequent class is compared with all its blocks, so no link
   between classes is lost.

Defined cases: null and blank texts have no shingles, are equal to each other and form one class;
texts of fewer than five words have one shingle of all words; the row with the smallest doc_id of a
class stays, null ids last, of equal ids the one with the smallest text_key, and one only; rows are told
apart by a number written with them, so doc_ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, numbered, spread, table
from .words import chunks, mix, shingles

THRESHOLD, BANDS, ROWS = 0.8, 20, 5
#: Bands whose buckets are compared first.
FIRST = 4
#: Members of a bucket that are compared at once; small buckets share a unit of about as many rows.
BLOCK = 256
#: Shingles of a block that are multiplied at once.
COLUMNS = 1 << 14


def multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted by text and shingle."""
    found, owner = shingles(texts)
    if not len(found):
        return owner, found, owner
    first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (found[1:] != found[:-1])]))
    return owner[first], found[first], np.diff(np.append(first, len(found)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _points(text, seed, weight, low, length, limit, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points before each text's limit: (text x register, time, identity)."""
    at = np.zeros(len(text))
    flat, times, names = [], [], []
    step = 0
    while len(text):
        step += 1
        r = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(_uniform(r)) / (length * registers)
        on = at < limit[text]
        text, seed, weight, low, length, at, r = (x[on] for x in (text, seed, weight, low, length, at, r))
        place = mix(r)
        height = low + ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 * length).astype(np.int64)
        below = height < weight
        flat.append((text * registers + (place % np.uint64(registers)).astype(np.int64))[below])
        times.append(at[below])
        names.append(r[below])
    return np.concatenate(flat), np.concatenate(times), np.concatenate(names)


def bag_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n x registers) of the texts 0 .. n-1; zeros for a text without shingles."""
    names = np.zeros(n * registers, np.uint64)
    mass = np.bincount(text, weight, n)
    margin = 4.0
    missing = mass > 0
    while missing.any():
        limit = np.where(missing, (np.log(registers) + margin) / np.maximum(mass, 1), 0.0)
        parts, low, length = [], 0, 1
        while len(on := np.flatnonzero((weight > low) & missing[text])):
            seed = mix(shingle[on] ^ mix(np.full(1, low + 1, np.uint64))[0])
            parts.append((text[on], seed, weight[on], np.full(len(on), low), np.full(len(on), length)))
            low += length
            length = low
        flat, times, found = _points(*(np.concatenate(x) for x in zip(*parts, strict=True)), limit, registers)
        first = np.full(n * registers, np.inf)
        np.minimum.at(first, flat, times)
        names[flat[hit]] = found[hit] if len(hit := np.flatnonzero(times == first[flat])) else 0
        full = np.isfinite(first.reshape(n, registers)).all(1)
        missing &= ~full  # a register without a point: look further in that text
        margin += 8
    return names.reshape(n, registers)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per text and band."""
    rows = signatures.shape[1] // bands
    out = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + signatures[:, b * rows + j])
        out[:, b] = key
    return out


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, doc_id, digest, text) to (place, doc_id, digest, exact, n, bands)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(3).to_pylist()]
        for part in chunks(texts):
            text, shingle, weight = multisets(texts[part])
            n = part.stop - part.start
            keys = band_keys(bag_minhash(text, shingle, weight, n)).view(np.int64)
            cuts = np.searchsorted(text, np.arange(n + 1))
            exact = [
                hashlib.blake2b(shingle[a:b].tobytes() + weight[a:b].tobytes(), digest_size=16).digest()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            sizes = np.bincount(text, weight, n).astype(np.int64)
            offsets = pa.array(np.arange(n + 1) * keys.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i)[part.start : part.stop] for i in range(3)),
                    pa.array(exact, pa.binary()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                names=["place", "doc_id", "digest", "exact", "n", "bands"],
            )


def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, elements): the multiset as a sorted set, the k-th occurrence of a shingle hashed with k."""
    for batch in batches:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for part in chunks(texts):
            found, owner = shingles(texts[part])
            new = np.concatenate([[True], (np.diff(owner) != 0) | (found[1:] != found[:-1])])[: len(found)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
            repeat = (np.arange(len(found)) - first).astype(np.uint64)
            found = np.where(repeat == 0, found, mix(found + repeat * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)
            cuts = np.searchsorted(owner, np.arange(part.stop - part.start + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids[part.start : part.stop], pa.ListArray.from_arrays(pa.array(cuts), pa.array(found))], names=["id", "elements"]
            )


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Matrix of the sizes of all intersections of two lists of sets, or of one list with itself.

    Elements that one row alone holds can't be shared; the others are numbered and multiplied as
    0/1 matrices, COLUMNS of them at a time.
    """
    rows = left + (right or [])
    first = 0 if right is None else len(left)
    sizes = [len(x) for x in rows]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    out = np.zeros((len(left), len(rows) - first), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((len(sizes), min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        out += block[: len(left)] @ block[first:].T
    return out


def forest(label: np.ndarray, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join different labels, one by one."""
    parent = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in pairs:
        a, b = root(label[i]), root(label[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one unit's buckets; rows: bucket, id, label, visitor, elements."""
    out = []
    for _, group in rows.groupby("bucket", sort=False):
        home = group[~group.visitor]
        guests = group[group.visitor] if group.visitor.any() else home
        if not len(home) or not len(guests):
            continue
        left, right = list(home.elements), list(guests.elements)
        shared = overlaps(left, None if guests is home else right)
        a, b = (np.array([len(x) for x in side], np.float32) for side in (left, right))
        near = shared >= THRESHOLD * (a[:, None] + b[None, :] - shared) - 1e-4
        near &= home.label.to_numpy()[:, None] != guests.label.to_numpy()[None, :]
        i, j = np.nonzero(near)
        label = np.concatenate([home.label.to_numpy(), guests.label.to_numpy()])
        ids = np.concatenate([home.id.to_numpy(), guests.id.to_numpy()])
        out += [(int(ids[x]), int(ids[y])) for x, y in forest(label, zip(i.tolist(), (j + len(home)).tolist(), strict=True))]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label): label is the smallest id that links lead to. Minimum labels with pointer jumping."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = ids.select("id", F.col("id").alias("label"))
    while True:
        near = both.join(labels, both.a == labels.id).groupBy("b").agg(F.min("label").alias("near"))
        lower = materialise(
            labels.join(near, labels.id == near.b, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new")), "near-step"
        )
        jump = lower.select(F.col("id").alias("new"), F.col("new").alias("further"))
        labels = materialise(
            lower.join(jump, "new").select("id", F.col("label").alias("old"), F.least("new", "further").alias("label")), "near-label"
        )
        if not labels.where("label != old").take(1):
            return labels.select("id", "label")
        labels = labels.select("id", "label")


def _links(members: DataFrame, sets: DataFrame, visitors: DataFrame | None = None) -> DataFrame:
    """Links found among ``members`` (bucket, id, label, unit) and, if given, between them and ``visitors``."""
    rows = members.withColumn("visitor", F.lit(False))
    if visitors is not None:
        rows = rows.unionByName(visitors.withColumn("visitor", F.lit(True)))
    return materialise(rows.join(sets, "id").groupBy("unit").applyInPandas(compare, "a bigint, b bigint"), "near-found")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) after links join classes: the classes are contracted first, so few rows iterate."""
    at = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
    between = links.join(at("a"), "a").join(at("b"), "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    between = materialise(between.distinct(), "near-between")
    if not between.take(1):
        return labels
    ids = materialise(between.select(F.col("a").alias("id")).union(between.select("b")).distinct(), "near-ends")
    joined = components(between, ids).select(F.col("id").alias("label"), F.col("label").alias("lower"))
    return materialise(labels.join(joined, "label", "left").select("id", F.coalesce("lower", "label").alias("label")), "near-labels")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets that hold several classes."""
    rows = materialise(members.drop("label").join(labels, "id"), "near-labelled")
    many = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    return materialise(rows.join(many, "bucket", "left_semi"), "near-unsettled")


def near_classes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, class_id, class_size, kept, text_key, class_key: one row per row of ``docs``.

    class_id and class_key are the doc_id and text_key of the row that stays; where doc_ids are null or
    repeat, class_key tells classes apart. ``row`` names a string column of ``docs`` that tells its rows apart,
    which the result then holds too. Inside, rows have the number that is written with their signatures.
    """
    spark = docs.sparkSession
    place = F.col(row) if row else F.lit(None).cast("string")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = docs.select(place.alias("place"), F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest"), "text")
    signed = map_arrow(rows, sign, "place string, doc_id bigint, digest binary, exact binary, n bigint, bands array<bigint>")
    signed = materialise(signed.withColumn("row", F.monotonically_increasing_id()), "near-signed")
    # the first row of a text gives the text its number
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "exact", "digest", "row")).alias("head")
    texts = materialise(signed.groupBy("exact").agg(head, F.count(F.lit(1)).alias("copies")).withColumn("id", F.col("head.row")), "near-texts")
    lead = signed.where("n > 0").join(texts.select("id"), signed.row == texts.id)
    entries = lead.select("id", F.posexplode("bands").alias("number", "band"))
    full = entries.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.bit_xor(F.xxhash64("id")).alias("members"), F.min("number").alias("number")
    ).where("size > 1")
    # equal members count once
    buckets = full.groupBy("size", "low", "members").agg(F.min(F.struct("number", "band")).alias("b")).select("size", "b.number", F.col("b.band").alias("bucket"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    units = max(1, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = F.col("size") <= BLOCK // 8
    shared = F.struct(F.pmod(F.xxhash64("bucket"), F.lit(units)).alias("at"), F.lit(-1).alias("block"), F.lit(0).alias("part"))
    members = materialise(
        entries.drop("number").join(buckets, entries.band == buckets.bucket).select(
            "bucket", "id", F.col("id").alias("label"), "number", blocks.alias("blocks"), few.alias("few"),
            F.pmod(F.xxhash64("id", "bucket"), blocks).cast("int").alias("block"),
        ),
        "near-members",
    )
    at = lambda part: F.struct(F.col("bucket").alias("at"), "block", part.alias("part"))
    unit = F.when(F.col("few"), shared).otherwise(at(F.lit(0))).alias("unit")
    ids = materialise(members.select("id").distinct(), "near-ids")
    # texts are found again by what they are; rows that both agree in hold the same text
    want = texts.join(ids, "id").select("id", F.col("head.doc_id").alias("i"), F.col("head.digest").alias("d"))
    sources = rows.join(want, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).select("id", "text")
    sets = materialise(map_arrow(sources, elements, "id bigint, elements array<bigint>").dropDuplicates(["id"]), "near-sets")
    pick = lambda d, to: d.select("bucket", "id", "label", to)
    # the first bands settle most classes; of the others only buckets that hold several classes are left
    labels = merged(ids.select("id", F.col("id").alias("label")), _links(pick(members.where(F.col("number") < FIRST), unit), sets))
    left = unsettled(members.where(F.col("number") >= FIRST), labels)
    labels = merged(labels, _links(pick(left, unit), sets))
    # blocks of one bucket have not met yet: rows outside its most frequent class visit the other blocks
    apart = unsettled(members.where("blocks > 1"), labels)
    counted = apart.groupBy("bucket", "label").count()
    main = counted.groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("outside"))
    spread = materialise(apart.join(main.withColumn("parts", F.ceil(F.col("outside") / BLOCK).cast("int")), "bucket"), "near-spread")
    if spread.take(1):
        homes = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        guests = (
            spread.where("label != main")
            .withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
            .withColumn("own", F.col("block"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .where("block != own")
        )
        to = at(F.col("part")).alias("unit")
        labels = merged(labels, _links(pick(homes, to), sets, pick(guests, to)))
    named = materialise(texts.join(labels, "id", "left").select("exact", "copies", "head", F.coalesce("label", "id").alias("label")), "near-named")
    sizes = materialise(named.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min("head").alias("first")), "near-sizes")
    classes = materialise(named.join(sizes, "label").select("exact", "class_size", "first"), "near-classes")
    return signed.select("row", "place", "doc_id", "exact").join(classes, "exact").select(
        *([F.col("place").alias(row)] if row else []),
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("exact")).alias("text_key"),
        F.lower(F.hex("first.exact")).alias("class_key"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, with its own columns."""
    rows, row = numbered(docs, "near-input")
    kept = near_classes(rows, row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spread(table(spark, sf_dir, "documents")))
