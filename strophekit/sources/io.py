"""Sources and sinks (S1-S8, K1-K3).  Explicit schemas, no inference;
writers always target a new directory and rely on Spark's commit protocol
(task output is committed atomically, so retried tasks leave no partial
files)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SONGS_SCHEMA = ("id LONG, song STRING, artist STRING, prompt STRING, "
                "model_response STRING, target_response STRING")
LYRICS_SCHEMA = "id LONG, lyrics STRING, annotation STRING"
CATALOGUE_SCHEMA = "artist STRING, artist_id LONG, song STRING, song_id LONG"
PROMPTS_SCHEMA = "id LONG, song STRING, artist STRING, lyrics STRING, prompt STRING"
JUDGE_SCHEMA = "question_id INT, model STRING, turn INT, score DOUBLE"


def read_json_array(spark: SparkSession, path: str, schema: str = SONGS_SCHEMA) -> DataFrame:
    """A file holding one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """S3: CSV whose quoted fields may hold newlines."""
    return (spark.read.schema(schema).option("header", header).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def read_syllable_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word=syl-la-ble`` lines -> ``(word, num_syllables, syllables)``;
    syllables split on runs of non-letters, the first entry of a word wins: by
    file path, then by place in the file (start of the split, line inside it), however
    the files are dealt to tasks."""
    place = ["_file", "_split", "_line"]
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"), F.col("value"))
    parts = raw.select(*place, F.split("value", "=", 2).alias("_kv")).filter(F.size("_kv") == 2)
    parts = parts.select(*place, F.element_at("_kv", 1).alias("word"),
                         F.filter(F.split(F.element_at("_kv", 2), "[^a-zA-Z]+"),
                                  lambda s: s != "").alias("syllables"))
    from strophekit.operators.relational import dedup_first
    out = dedup_first(parts, ["word"], place).drop(*place)
    return out.select("word", F.size("syllables").alias("num_syllables"), "syllables")


def read_word_list(spark: SparkSession, path: str, pad: bool = False,
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """Newline word list without blanks; optionally space-padded terms
    and extra words appended."""
    w = spark.read.text(path).select(F.col("value").alias("word")).filter(F.col("word") != "")
    if extra:
        w = w.unionByName(spark.createDataFrame([(x,) for x in extra], "word string"))
    return w.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("word")) if pad else w


def votes_from_json_text(df: DataFrame, col: str = "value") -> DataFrame:
    """A JSON array of ``{song id: chosen model}`` maps -> one row per
    vote ``(id, chosen_model)``."""
    arr = F.from_json(F.col(col), "array<map<string,string>>")
    ballots = df.select(F.explode(arr).alias("_m"))
    votes = ballots.select(F.explode("_m").alias("_id", "chosen_model"))
    return votes.select(F.col("_id").cast("long").alias("id"), "chosen_model")


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """S6 from a file (the whole array is one JSON text)."""
    return votes_from_json_text(spark.read.option("wholetext", True).text(path), "value")


def read_model_outputs(spark: SparkSession, paths: Mapping[str, str], schema: str = SONGS_SCHEMA,
                       skip: str | None = None, multiline: bool = True) -> DataFrame:
    """Many model output files (or folders), each tagged with its model name, by
    one scan; files whose own name contains ``skip`` are left out (default: none)."""
    kept = {m: p.rstrip("/") for m, p in paths.items() if not (skip and skip in p.rstrip("/").rsplit("/", 1)[-1])}
    if not kept:
        raise ValueError("no model files left to read")
    rows = spark.read.schema(schema).option("multiLine", multiline).json(list(kept.values()))
    file = F.regexp_replace(F.url_decode("_metadata.file_path"), "^[a-z0-9]+:/+", "/")
    model = F.coalesce(*[F.when((file == _local(p)) | file.startswith(_local(p) + "/"), F.lit(m))
                         for m, p in sorted(kept.items(), key=lambda e: -len(e[1]))])
    return rows.select("*", model.alias("model"))


def read_model_folder(spark: SparkSession, path: str, models: DataFrame, schema: str = SONGS_SCHEMA,
                      multiline: bool = True, file_key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """S8 for any number of models: ``(rows, rejects)`` of all files below ``path`` by one scan.

    ``models`` is a table ``(file, model)``; a row takes the model of its file's name (or of
    ``file_key``, a column over the hidden ``_metadata``).  Rows of files that the table does
    not name go to ``rejects`` as ``(file, n_rows)``.  One model per file is kept (the least)."""
    name = F.col("_metadata.file_name") if file_key is None else file_key
    rows = spark.read.schema(schema).option("multiLine", multiline).option("recursiveFileLookup", True).json(path)
    rows = rows.select("*", name.alias("_file"))
    table = models.groupBy(F.col("file").alias("_file")).agg(F.min("model").alias("model"))
    tagged = rows.join(table, "_file", "left")
    rejects = tagged.filter(F.col("model").isNull()).groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return tagged.filter(F.col("model").isNotNull()).drop("_file"), rejects


def _local(path: str) -> str:
    """A path without its scheme."""
    return re.sub("^[a-z0-9]+:/+", "/", path)


def write_json(df: DataFrame, path: str) -> None:
    """K1/K2: JSON lines to a new directory."""
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """K3: CSV with header and a column choice."""
    (df.select(*(columns or df.columns)).write.mode("errorifexists")
     .option("header", True).option("quote", '"').option("escape", '"').csv(path))
