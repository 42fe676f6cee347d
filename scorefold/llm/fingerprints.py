"""Document fingerprints: the bottom-k sketch of a text's hashed word shingles.

A fingerprint is the ascending array of the ``k`` smallest distinct 64-bit hashes of all shingles
of ``WIDTH`` words (words are runs of non-space characters). Sketches of parts merge into the sketch
of the whole, and estimate resemblance, containment and the number of distinct shingles.

Defined cases: null text counts as empty; a text without words has the empty fingerprint; one of
fewer than WIDTH words has one shingle of all its words; two empty fingerprints resemble each other
fully, an empty and a full one not at all. Everything is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

K, WIDTH = 128, 5
MAX_PARTS = 4096


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array of words of column ``text``."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s+", " "))
    return df.withColumn(out, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " ")))


def sketch(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """Fingerprint of an array column of words; the column must be materialised, not an expression."""
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
    hashes = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), at)).when(
        F.size(words) > 0, F.array(F.xxhash64(words))
    )
    return F.slice(F.sort_array(F.array_distinct(F.coalesce(hashes, F.array().cast("array<bigint>")))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Exact below k shingles, else (k - 1) over the k-th smallest hash as a share of the hash range."""
    share = (F.element_at(s, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    part = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), part))


def merge_groups(df: DataFrame, keys: list[str], fingerprint: str, k: int = K) -> DataFrame:
    """One merged sketch per group; each task sends at most k hashes of a group onwards."""
    hashes = df.select(*keys, F.explode(fingerprint).alias("hash")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash")))
    return ranked.where(F.col("rank") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(fingerprint))


def encoded(s: Column) -> Column:
    """The sketch as a string: base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Adds to each row its own and the next document's text and words, in descending doc_id.

    Ranges of ids are cut at ids that occur, at most MAX_PARTS of them; the row at the head of a
    range is also dealt to the range before it, so one shuffle of the texts is enough and no task
    holds more than a range. After the last document comes the first.
    """
    lowest = -(2**63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "place", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(lowest))
    )
    shares = [i / parts for i in range(1, parts)]
    cut = rows.agg(F.percentile_approx("place", shares, 100 * parts).alias("cuts"), F.max("place").alias("top")).first()
    heads = sorted({*(cut.cuts or []), cut.top} - {None}) or [lowest]
    known = F.array(*[F.lit(x).cast("bigint") for x in heads])
    own = F.size(F.filter(known, lambda b: b < F.col("place")))
    # the head of range i also ends range i + 1; the head of the last one ends range 0
    dealt = F.when(F.array_contains(known, F.col("place")), F.array(own, (own + 1) % len(heads))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "place", F.posexplode(dealt).alias("guest", "part")).repartition("part")
    sketched = with_words(dealt, "text", "words").withColumn("fingerprint", sketch(F.col("words"))).drop("words")
    order = Window.partitionBy("part").orderBy("guest", F.desc("place"), F.xxhash64("text"))
    return (
        sketched.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .where("guest = 0")
        .drop("guest", "part", "place")
    )


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    spark = docs.sparkSession
    parts = min(MAX_PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_next(docs, parts).select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"),
        "fingerprint",
        "next_fingerprint",
    )
    sketched = with_words(edited, "edited", "words").withColumn("edited_fingerprint", sketch(F.col("words"), k))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        resemblance(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"),
        resemblance(F.col("fingerprint"), F.col("next_fingerprint"), k).alias("near_next"),
        distinct_shingles(F.col("fingerprint"), k).alias("n_shingles"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({c: encoded(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})
