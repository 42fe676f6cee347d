"""Sweeps over a run's folders of predictions: confidences and affinities beside the structures that they belong to.

A run holds ``outputs/<model>/...``. Structures are numbered by their place among all structures of their model, sorted by
path, part by part; empty files are none. Files are found by one recursive listing, contents read of JSON files only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Models whose outputs hold an affinity.
AFFINITY_MODELS = ("boltz2", "boltz2x")
MODELS = (*AFFINITY_MODELS, "protenix", "alphafold3")


def _files(spark: SparkSession, run: str, pattern: str) -> DataFrame:
    """model, parts (of the path below the model), folder, name, content of the files of a run that match ``pattern``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(f"{run.rstrip('/')}/outputs")
    below = F.split(F.regexp_extract("path", r"^.*?/outputs/(.*)$", 1), "/")
    rows = found.select(below.alias("p"), "path", "content").where(F.size("p") > 1)
    name = F.element_at("p", -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return rows.select(F.col("p")[0].alias("model"), F.slice("p", F.lit(2), F.size("p") - 1).alias("parts"), folder.alias("folder"), name.alias("name"), "content")


def _jsons(spark: SparkSession, run: str, pattern: str) -> DataFrame:
    return _files(spark, run, pattern).withColumn("text", F.decode("content", "UTF-8")).drop("content")


def _value(key: str | Column, text: str = "text") -> Column:
    path = F.concat(F.lit("$."), key) if isinstance(key, Column) else F.lit(f"$.{key}")
    return F.call_function("get_json_object", F.col(text), path).try_cast("double")


def structures(spark: SparkSession, run: str) -> DataFrame:
    """model, pose (from 0), folder, name, stem of every aligned structure of the known models."""
    rows = _files(spark, run, "*_aligned.cif").where(F.col("model").isin(*MODELS)).drop("content")
    place = F.row_number().over(Window.partitionBy("model").orderBy("parts")) - 1  # names of files only
    return rows.select("model", place.alias("pose"), "folder", "name", F.replace(F.regexp_replace("name", r"\.cif$", ""), F.lit("_aligned"), F.lit("")).alias("stem"))


def _last(stem: Column, mark: str) -> Column:
    """What follows the last ``mark``; all of it without one."""
    return F.regexp_replace(stem, f"^.*{mark}", "")


def confidences(spark: SparkSession, run: str) -> DataFrame:
    """model, pose, iptm, ptm, plddt, conf of every structure, NULL where the file or the value is missing or can't be read.

    plddt is on a scale of 100: times 100 for the models that give it on 1, NULL for the one that has none. A structure
    whose own summary is missing takes the first summary of its folder, for the model that names them by job.
    """
    rows = structures(spark, run)
    boltz, stem = F.col("model").isin(*AFFINITY_MODELS), F.col("stem")
    sample = F.regexp_extract(stem, "^(.*)_sample_(.*)$", 1), F.regexp_extract(stem, "^(.*)_sample_(.*)$", 2)
    wanted = (
        F.when(boltz, F.concat(F.lit("confidence_boltz_input_model_"), _last(stem, "_model_"), F.lit(".json")))
        .when((F.col("model") == "protenix") & stem.contains("_sample_"), F.concat(sample[0], F.lit("_summary_confidence_sample_"), sample[1], F.lit(".json")))
        .when(F.col("model") == "alphafold3", F.concat(stem, F.lit("_summary_confidences.json")))
    )
    read = _jsons(spark, run, "*.json").where(F.col("name").contains("confidence")).select("folder", F.col("name").alias("wanted"), "text")
    first = read.where(F.col("wanted").endswith("_summary_confidences.json")).groupBy("folder").agg(F.min_by("text", "wanted").alias("any"))
    joined = rows.withColumn("wanted", wanted).join(read, ["folder", "wanted"], "left").join(first, "folder", "left")
    text = F.when((F.col("model") == "alphafold3") & F.col("text").isNull(), F.col("any")).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    plddt = F.when(boltz, _value("complex_plddt") * 100).when(F.col("model") == "protenix", _value("plddt"))
    conf = F.when(boltz, _value("confidence_score")).otherwise(_value("ranking_score"))
    return joined.select("model", "pose", _value("iptm").alias("iptm"), _value("ptm").alias("ptm"), plddt.alias("plddt"), conf.alias("conf"))


def affinities(spark: SparkSession, run: str) -> DataFrame:
    """source, value, probability of every affinity file: its main value, and its numbered ones from 1 to 9 that have both.

    A source is model and seed folder (``default`` without one), and ``sample_<n>`` for numbered values.
    """
    below = F.array_join("parts", "/")
    rows = _jsons(spark, run, "affinity_*.json").where(F.col("model").isin(*AFFINITY_MODELS))
    rows = rows.where(below.rlike(r"^(seed_[^/]*/)?boltz_results_[^/]*/predictions/[^/]*/[^/]*$"))
    seed = F.coalesce(F.get(F.filter("parts", lambda p: p.startswith("seed_")), F.lit(0)), F.lit("default"))
    numbers = F.explode(F.array(*[F.lit(s) for s in ("", *map(str, range(1, 10)))])).alias("n")
    rows = rows.select(F.concat_ws("/", "model", seed).alias("source"), "text", numbers)
    named = F.when(F.col("n") == "", F.col("source")).otherwise(F.concat("source", F.lit("/sample_"), "n"))
    value, probability = (_value(F.concat(F.lit(k), "n")) for k in ("affinity_pred_value", "affinity_probability_binary"))
    return rows.select(named.alias("source"), value.alias("value"), probability.alias("probability")).dropna()


def pose_affinities(spark: SparkSession, run: str) -> DataFrame:
    """model, pose, value, probability of the structures of affinity models that have both.

    They come from the first affinity file of the structure's folder: the values of its model number, else the main ones.
    """
    rows = structures(spark, run).where(F.col("model").isin(*AFFINITY_MODELS)).withColumn("nth", _last(F.col("stem"), "_model_").try_cast("int"))
    first = _jsons(spark, run, "affinity_*.json").groupBy("folder").agg(F.min_by("text", "name").alias("text"))
    joined = rows.where("nth IS NOT NULL").join(first, "folder")

    def own(key: str) -> Column:
        numbered = _value(F.concat(F.lit(key), F.col("nth").cast("string")))
        return F.coalesce(F.when(F.col("nth") > 0, numbered), _value(key))

    return joined.select("model", "pose", own("affinity_pred_value").alias("value"), own("affinity_probability_binary").alias("probability")).dropna()
