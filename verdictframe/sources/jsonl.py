"""File scans with fixed schemas; keys come from paths and file names."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictframe.functions.draws import dense_index
from verdictframe.operators.battles import latest

# Schemas as DDL text.
MESSAGES = "array<struct<role:string,content:string>>"
VOTE = (
    "timestamp string, model_a string, model_b string, initial_prompt string, action_a string, "
    f"action_b string, conversation_a {MESSAGES}, conversation_b {MESSAGES}, vote string"
)
JUDGE_RESULT = "chat_session_id string, model_A string, model_B string, judgment string"
SANDBOX_SIDE = (
    "struct<messages:array<array<string>>,sandbox_logs_by_round:map<string,"
    "struct<sandbox_state:struct<sandbox_output:string,screenshot_base64:string>>>>"
)
REWARD_RECORD = (
    "chat_session_id string, instruction string, model_A string, model_B string, human_vote string, "
    "vote_type string, category_name string, category_id string, "
    f"states struct<model_A:{SANDBOX_SIDE},model_B:{SANDBOX_SIDE}>"
)
QUESTION_KEYS = ["uid", "instruction", "category"]
QUESTION = "uid string, instruction string, category string"
GENERATED_QUESTION = f"{QUESTION}, source_seeds array<string>, generation_method string"
GENERATION = (
    "uid string, category string, instruction string, model string, environment string, "
    f"ans_id string, tstamp double, messages {MESSAGES}, "
    "code_to_execute string, language string, code_dependencies array<array<string>>"
)
EXECUTION = (
    f"{GENERATION}, stdout string, stderr string, screenshot_path string, visual_outputs array<string>"
)
JUDGMENT = (
    "uid string, environment string, judge string, model string, baseline string, "
    "games array<struct<score:string>>"
)
RATES = "map<string,struct<total:bigint,success:bigint,success_rate:double>>"
SUMMARY = (
    "total_executions bigint, successful bigint, failed bigint, success_rate double, "
    f"by_environment {RATES}, by_category {RATES}"
)
JUDGE_VERDICT = "struct<judgment:string,judger_type:string,version:string,timestamp:string>"
ANNOTATED = (
    "chat_session_id string, model_A string, model_B string, "
    f"feedback map<string,map<string,{JUDGE_VERDICT}>>"
)
# A named file may also be a folder of part files under that name.
PARTS = r"(?:/[^/]+)?$"


def _scan(spark: SparkSession, path: str, schema: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """JSON lines with their file and line order; blank lines are skipped.

    ``_line`` orders the rows of one file: a file split keeps its start offset and
    is read front to back within one task.
    """
    rows = spark.read.schema(schema).option("mode", mode).json(path)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    start = F.col("_metadata.file_block_start").cast("decimal(38,0)")
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        (start * F.lit(2**33).cast("decimal(11,0)") + within).cast("decimal(38,0)").alias("_line"),
    )


def _part(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract("_file", pattern, group)


def judge_results(spark: SparkSession, root: str) -> DataFrame:
    """``root/{judge}/{with,without}_execution/*.jsonl``, failed files left out.

    All files of a folder are read; malformed lines are dropped.
    """
    rows = _scan(spark, f"{root}/*/*/*.jsonl", JUDGE_RESULT)
    keys = r"/([^/]+)/((?:with|without)_execution)/([^/]+\.jsonl)" + PARTS
    return (
        rows.withColumn("judge", _part(keys, 1)).withColumn("mode", _part(keys, 2))
        .filter((F.col("mode") != "") & ~_part(keys, 3).contains("_failed"))
        .drop("_file", "_line")
    )


def judge_results_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Files ``{judge}_{with,without}_execution.jsonl``; other names are skipped."""
    rows = _scan(spark, f"{folder}/*.jsonl", JUDGE_RESULT)
    keys = r"/([^/]+)_((?:with|without)_execution)\.jsonl" + PARTS
    return (
        rows.withColumn("judge", _part(keys, 1)).withColumn("mode", _part(keys, 2))
        .filter(F.col("mode") != "").drop("_file", "_line")
    )


def annotations(records: DataFrame) -> DataFrame:
    """Verdicts nested as mode -> judge flattened to one row each."""
    modes = records.select(
        "chat_session_id", "model_A", "model_B", F.explode("feedback").alias("kind", "judges")
    )
    rows = modes.select(
        "chat_session_id", "model_A", "model_B", "kind", F.explode("judges").alias("judge", "v")
    )
    mode = F.when(F.col("kind").contains("no_execution"), "without_execution").otherwise("with_execution")
    return rows.select("chat_session_id", "model_A", "model_B", "judge", mode.alias("mode"), "v.judgment")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The later line of a key wins; files of one key are ordered by name."""
    out = rows.withColumn("_at", F.struct("_file", "_line")).drop("_file", "_line")
    return latest(out, keys, "_at").drop("_at")


def model_answers(spark: SparkSession, root: str, file: str = "generation.jsonl") -> DataFrame:
    """``root/{model}/{file}``: the last line per model and uid.

    Models without the file are simply not matched by the pattern.
    """
    schema = EXECUTION if file == "execution_results.jsonl" else GENERATION
    rows = _scan(spark, f"{root}/*/{file}", schema)
    rows = rows.withColumn("model", _part(rf"/([^/]+)/{file}{PARTS}"))
    return _newest(rows, ["model", "uid"])


def model_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """``folder/{model}.jsonl``: the last line per model and uid."""
    rows = _scan(spark, f"{folder}/*.jsonl", JUDGMENT)
    rows = rows.withColumn("model", _part(r"/([^/]+)\.jsonl" + PARTS))
    return _newest(rows, ["model", "uid"])


def by_model(rows: DataFrame) -> DataFrame:
    """uid -> map of model to its row; at most one entry per model."""
    rest = [c for c in rows.columns if c not in ("uid", "model")]
    entry = F.struct(F.col("model"), F.struct(*rest).alias("row"))
    return rows.groupBy("uid").agg(F.map_from_entries(F.collect_list(entry)).alias("models"))


def lines(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    """Line-JSON that must be well formed."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def array_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files holding one JSON array each, one row per element.

    A file is read by one task; land large inputs as line-JSON or Parquet.
    """
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def landed_questions(spark: SparkSession, path: str) -> DataFrame:
    """Three columns of a landed dataset; the scan reads no others."""
    return spark.read.parquet(path).select("uid", "instruction", "category")


def generated_questions(spark: SparkSession, folder: str) -> DataFrame:
    """``{category}_generated.jsonl`` files with one running index over all.

    Files count in name order, lines in file order. Each file is indexed by the
    bounded-bucket numbering, then shifted by the sizes of the earlier files.
    """
    rows = _scan(spark, f"{folder}/*_generated.jsonl", GENERATED_QUESTION, "FAILFAST")
    rows = rows.withColumn("file_category", _part(r"/([^/]+)_generated\.jsonl" + PARTS))
    # Part files of one name count in name order: their number leads the line order.
    number = F.coalesce(_part(r"/part-(\d+)[^/]*$").try_cast("decimal(38,0)"), F.lit(0))
    at = (number * F.lit(Decimal(2**80)) + F.col("_line")).cast("decimal(38,0)")
    rows = dense_index(
        rows.withColumn("_line", at).drop("_file"), ["file_category"], "_line", "_at"
    ).drop("_line")
    sizes = rows.groupBy("file_category").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("file_category").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = sizes.select("file_category", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(shifts, "file_category").withColumn(
        "question_index", F.col("_at") + F.col("_shift")
    ).drop("_at", "_shift")


def seed_file_report(spark: SparkSession, path: str) -> DataFrame:
    """Valid rows per seed file; any bad row makes the file invalid."""
    rows = spark.read.schema(f"{QUESTION}, _corrupt_record string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    ).json(path)
    bad = F.col("_corrupt_record").isNotNull()
    for name in QUESTION_KEYS:
        bad = bad | F.col(name).isNull()
    report = rows.select(
        F.regexp_extract("_metadata.file_path", r"/([^/]+\.jsonl)" + PARTS, 1).alias("file"), bad.alias("bad")
    )
    return report.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("bad")).alias("bad_rows")
    ).withColumn("valid", F.col("bad_rows") == 0)


def execution_summaries(spark: SparkSession, root: str) -> DataFrame:
    """``root/{model}/execution_summary.json`` as rows per level and value."""
    rows = spark.read.schema(SUMMARY).option("multiLine", True).json(f"{root}/*/execution_summary.json")
    rows = rows.withColumn("model", F.regexp_extract("_metadata.file_path", r"/([^/]+)/execution_summary\.json" + PARTS, 1))
    overall = rows.select(
        "model", F.lit("overall").alias("level"), F.lit("").alias("value"),
        F.col("total_executions").alias("total"), F.col("successful").alias("success"), "success_rate",
    )
    for level in ("environment", "category"):
        part = rows.select("model", F.explode(f"by_{level}").alias("value", "s"))
        overall = overall.unionByName(part.select(
            "model", F.lit(level).alias("level"), "value", "s.total", "s.success", "s.success_rate"
        ))
    return overall


def land(df: DataFrame, path: str, partitions: list[str], mode: str = "overwrite") -> None:
    """Land scanned rows once as Parquet in ``key=value`` folders.

    Later jobs then prune partitions and columns instead of re-reading text.
    """
    df.write.mode(mode).partitionBy(*partitions).parquet(path)
