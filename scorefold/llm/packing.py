"""Packing tokenised documents into sequences of a fixed capacity by bulk-synchronous best fit.

Documents become pieces of at most ``capacity`` tokens. Pieces of more than half of it can't share a
sequence with each other and open one each. The others are placed by bands of length, longest first;
a band's edges are the capacity over 2, 3, 4, ..., so its pieces go as often into an empty sequence.
A band is packed in rounds:

1. A gap of an open sequence offers a slot for each piece that surely fits. Slots and pieces are sorted by
   size, longest first; a row's global rank comes from counts per size and part.
2. A successor sweep gives each piece the smallest slot that holds it, each slot at most one piece. Read
   slots as opening and pieces as closing brackets: the brackets that match are those pairs. The depth
   of a row follows from its rank, so rows are dealt by depth, and in each depth neighbours match;
   ties of size are resolved by rank. A depth meets each size once, hence at most 2 x capacity rows.
3. Gaps shrink by what they took, and the next round follows with the pieces left over.

Where no gap is left for a band, or a round placed few of its pieces, sequences are opened: as many as the
tokens left need at least, or, for the last few pieces of a band, as many as surely hold them. Rounds
depend on the mix of lengths, not on the number of documents; the driver holds their counts per size.

Defined cases: null and empty texts are one piece of the end token; repeated rows are packed each
by itself; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialise, scratch, spread, table

CAPACITY, END = 1024, 2
#: Rows of one size are ranked in parts of about so many, so a frequent size isn't one group.
PART = 20_000
#: Upper edges of the bands: the capacity over each of these.
BANDS = (2, 3, 4, 5, 6, 8, 16, 64)
#: A round that places no more than this share of a band's pieces is followed by new sequences.
SLOW = 0.3
#: With at most this share of all pieces left of a band, new sequences are opened for all of them at once.
TAIL = 0.02
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
GAP, UNIT, PLACE = 0, 1, 2
STATE = "key bigint, size bigint, sequence_id bigint, offset bigint, kind int"
#: Any other character than those that the patterns of both tokenizer libraries surely class alike: Latin and
#: Russian letters, common punctuation, Han characters.
UNSURE = re.compile("[^\0-\u024f\u0410-\u044f\u2010-\u2027\u4e00-\u9fa5]")
#: Longer runs of white space exhaust the rank file's pattern matcher; such texts go to the model's own tokenizer.
RUN = 1024
LONG_RUN = re.compile(rf"\s{{{RUN}}}")


def byte_bpe(model: str, ranks: str, plain: bool = False) -> Callable[[str], bytes]:
    """text -> ids of the byte-level BPE as little-endian 32-bit numbers, without special tokens.

    The ids are those of the tokenizer of the ``model`` file. The rank file holds the same merges and is
    several times as fast; it serves the texts whose characters both classify alike and that hold no
    name of an added token and no long run of white space. With ``plain`` such names are ordinary text.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    full = Tokenizer.from_file(model)
    full.encode_special_tokens = plain
    added = [] if plain else [t.content for t in full.get_added_tokens_decoder().values()]

    def ids(text: str) -> bytes:
        odd = any(t in text for t in added) or (not text.isascii() and UNSURE.search(text))
        if odd or (len(text) >= RUN and LONG_RUN.search(text)):
            return np.array(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return ids


def cut(model: str, ranks: str, capacity: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to pieces; the first piece of a longer document is the shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = byte_bpe(model, ranks)
        tail = struct.pack("<I", end)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (ids(text) if text else b"") + tail
                n = len(data) // 4
                at, number = 0, 0
                while at < n:
                    length = (n % capacity or capacity) if at == 0 else capacity
                    crc = zlib.crc32(data[4 * at : 4 * (at + length)])
                    rows.append((doc_id, number, at, length, crc))
                    at, number = at + length, number + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run



def ranked(rows: DataFrame, before: dict[tuple[int, int], int], parts: int) -> DataFrame:
    """Adds ``depth``: slots so far minus pieces so far, by size (longest first), kind and rank; a slot counts itself.

    ``before`` holds that difference at the head of each (size, kind): at most 2 x capacity numbers.
    """
    at = ["size", "kind", "part"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", "slot"), F.lit(parts)))
    heads = rows.sparkSession.createDataFrame([(*k, v) for k, v in before.items()], "size bigint, kind int, head bigint")
    inside = Window.partitionBy("size", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*at).count().join(F.broadcast(heads), ["size", "kind"])
    base = base.select(*at, "head", F.coalesce(F.sum("count").over(inside), F.lit(0)).alias("inside"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("key", "slot")) - 1 + F.col("inside")
    joined = dealt.join(base, at).withColumn("rank", rank)
    return joined.withColumn("depth", F.when(F.col("kind") == GAP, F.col("head") + F.col("rank") + 1).otherwise(F.col("head") - F.col("rank")))


def sweep(slots: DataFrame, units: DataFrame, before: dict[tuple[int, int], int], parts: int) -> DataFrame:
    """Slots (key, slot, size, whole, left) and pieces (key, size), each with the mate of the other kind or null."""
    rows = slots.withColumn("kind", F.lit(GAP)).unionByName(units.select("key", F.lit(0).alias("slot"), "size", F.lit(UNIT).alias("kind")), allowMissingColumns=True)
    order = Window.partitionBy("depth").orderBy(F.desc("size"), "kind")
    row = F.struct("kind", "key", "size")
    near = F.when(F.col("kind") == GAP, F.lead(row).over(order)).otherwise(F.lag(row).over(order))
    placed = ranked(rows, before, parts).withColumn("near", near)
    mate = F.when(F.col("near.kind") != F.col("kind"), F.col("near"))
    return placed.select("kind", "key", "slot", "size", "whole", mate.alias("mate"))


def settled(swept: DataFrame, capacity: int) -> DataFrame:
    """Rows of STATE after a sweep: places of pieces, gaps with what is left of them, pieces left over."""
    swept = swept.where((F.col("kind") == GAP) | F.col("mate").isNull())
    owner = Window.partitionBy("kind", "key")
    taken = F.coalesce(F.sum("mate.size").over(owner.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("whole") - F.coalesce(F.sum("mate.size").over(owner), F.lit(0))
    swept = swept.withColumns({"taken": taken, "left": left})
    none = F.lit(None).cast("bigint")

    def row(kind: int, key: Column, size: Column, sequence: Column = none, offset: Column = none) -> Column:
        values = (key, size, sequence, offset, F.lit(kind))
        return F.struct(*[v.alias(n.split()[0]) for v, n in zip(values, STATE.split(", "), strict=True)])

    place = row(PLACE, F.col("mate.key"), F.col("mate.size"), F.col("key"), F.lit(capacity) - F.col("whole") + F.col("taken"))
    made = F.when(F.col("kind") == UNIT, F.array(row(UNIT, F.col("key"), F.col("size")))).otherwise(
        F.array(F.when(F.col("mate").isNotNull(), place), F.when((F.col("slot") == 0) & (F.col("left") > 0), row(GAP, F.col("key"), F.col("left"))))
    )
    return swept.select(F.explode(F.array_compact(made)).alias("row")).select("row.*")


def heads_of(slots: Counter, units: Counter) -> dict[tuple[int, int], int]:
    """Slots minus pieces before each (size, kind), longest first, slots before pieces of one size."""
    found, depth = {}, 0
    for size in sorted({*slots, *units}, reverse=True):
        for kind, step, count in ((GAP, 1, slots[size]), (UNIT, -1, units[size])):
            if count:
                found[size, kind] = depth
                depth += step * count
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (``length`` from 1 to capacity)."""
    spark = pieces.sparkSession
    rows = materialise(pieces.withColumn("key", F.monotonically_increasing_id()), "pack-rows")
    singles = rows.select("key", F.col("length").alias("size"))
    counts = Counter({r["size"]: r["count"] for r in singles.groupBy("size").count().collect()})  # at most capacity
    large = F.col("size") > capacity // 2
    parts = 1 + sum(counts.values()) // PART
    first = singles.where(large).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    gaps = singles.where(large & (F.col("size") < capacity)).select("key", (F.lit(capacity) - F.col("size")).alias("size"))
    held = Counter({capacity - n: c for n, c in counts.items() if capacity // 2 < n < capacity})
    folder, rounds, opened = scratch(spark, "pack-rounds"), 0, 0
    edges = sorted({capacity // b for b in BANDS} | {0}, reverse=True)
    for high, low in zip(edges[:-1], edges[1:], strict=True):
        units = singles.where((F.col("size") > low) & (F.col("size") <= high))
        waiting = Counter({n: c for n, c in counts.items() if low < n <= high})
        slow = False
        while waiting:
            widest, least, many = max(waiting), min(waiting), sum(waiting.values())
            usable = sum(c for g, c in held.items() if g >= least)
            cap = -(-many // max(usable, 1))
            slots = Counter()
            for g, c in held.items():
                if g >= least:
                    m = min(max(1, g // widest), cap)
                    slots[g // m] += c * m
            fit = F.least(F.greatest(F.lit(1), F.floor(F.col("size") / widest)), F.lit(cap)).cast("int")
            offers = gaps.where(F.col("size") >= least).withColumn("many", fit)
            if slow or not usable:
                each = capacity // widest
                new = -(-many // each) if many <= TAIL * sum(counts.values()) else -(-sum(n * c for n, c in waiting.items()) // capacity)
                fresh = spark.range(opened, opened + new).select((-1 - F.col("id")).alias("key"), F.lit(capacity).cast("bigint").alias("size"), F.lit(each).alias("many"))
                offers, opened = offers.unionByName(fresh), opened + new
                slots[capacity // each] += new * each
            each_slot = F.floor(F.col("size") / F.col("many"))
            offered = offers.select("key", F.col("size").alias("whole"), each_slot.alias("size"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("slot"))
            done = settled(sweep(offered, units, heads_of(slots, waiting), parts), capacity)
            idle = gaps.where(F.col("size") < least).select("key", "size", F.lit(GAP).alias("kind"))
            path = f"{folder}/{rounds}"
            done.unionByName(idle, allowMissingColumns=True).write.partitionBy("kind").parquet(path)
            state, rounds = spark.read.schema(STATE).parquet(path), rounds + 1
            gaps, units = (state.where(F.col("kind") == k).select("key", "size") for k in (GAP, UNIT))
            held, waiting = Counter(), Counter()
            for r in state.where(F.col("kind") != PLACE).groupBy("kind", "size").count().collect():  # at most 2 x capacity
                (held if r["kind"] == GAP else waiting)[r["size"]] = r["count"]
            slow = many - sum(waiting.values()) <= SLOW * many or sum(waiting.values()) <= TAIL * sum(counts.values())
    found = first
    if rounds:
        found = found.unionByName(spark.read.schema(STATE).parquet(f"{folder}/*/kind={PLACE}").select(found.columns))
    return rows.join(found, "key").drop("key")


def pack_documents(
    docs: DataFrame, model: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    import public_tokenizers

    model = model or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return pack(map_arrow(rows, cut(model, ranks, capacity, end), PIECES), capacity)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents that came so far."""
    return pack_documents(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents")))
