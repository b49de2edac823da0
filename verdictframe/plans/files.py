"""Queries through files: tables written as the inputs the scans expect, read back.

Every call writes a fresh folder below the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.operators import agreement, battles, quality
from verdictframe.plans.agreement import rounded
from verdictframe.plans.enrichment import TASKS, tasks
from verdictframe.plans.registry import query
from verdictframe.plans.text import EXEC
from verdictframe.session import scratch_path as fresh
from verdictframe.sources import files, jsonl, sinks
from verdictframe.sources.views import table, view


def write_lines(df, path: str) -> None:
    """Rows as JSON lines in a folder of part files under the file's name."""
    df.write.mode("overwrite").json(path)


JUDGES = [(j, m) for j in ("jA", "jB") for m in ("with_execution", "without_execution")]


def judge_lines(spark, sf, judge: str, mode: str):
    rows = view(spark, sf, "judge_rows").filter((F.col("judge") == judge) & (F.col("mode") == mode))
    return rows.select(
        "chat_session_id", F.col("model_a").alias("model_A"), F.col("model_b").alias("model_B"), "judgment"
    )


@query("judge_result_scan", """SELECT judge, mode, count(*) AS n, count(judgment) AS judged, count(DISTINCT chat_session_id) AS sessions
FROM judge_rows GROUP BY judge, mode""")
def judge_result_scan(spark, sf):
    """Several files per folder; failed files and broken lines do not count."""
    root = fresh(spark, "judge-results")
    for judge, mode in JUDGES:
        rows = judge_lines(spark, sf, judge, mode)
        write_lines(rows.filter("model_A < 'm06'"), f"{root}/{judge}/{mode}/part_one.jsonl")
        write_lines(rows.filter("model_A >= 'm06'"), f"{root}/{judge}/{mode}/part_two.jsonl")
        write_lines(rows, f"{root}/{judge}/{mode}/part_failed.jsonl")
    broken = view(spark, sf, "judge_rows").select(F.concat(F.lit('{"chat_session_id": "'), "chat_session_id").alias("value"))
    broken.write.text(f"{root}/jA/with_execution/broken.jsonl")
    rows = jsonl.judge_results(spark, root)
    return rows.groupBy("judge", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.count("judgment").alias("judged"),
        F.count_distinct("chat_session_id").alias("sessions"),
    )


@query("judge_result_scan_by_name", """SELECT judge, mode, judgment, count(*) AS n FROM judge_rows GROUP BY ALL""")
def judge_result_scan_by_name(spark, sf):
    root = fresh(spark, "judge-files")
    for judge, mode in JUDGES:
        write_lines(judge_lines(spark, sf, judge, mode), f"{root}/{judge}_{mode}.jsonl")
    write_lines(judge_lines(spark, sf, "jA", "with_execution"), f"{root}/notes.jsonl")
    rows = jsonl.judge_results_by_name(spark, root)
    return rows.groupBy("judge", "mode", "judgment").agg(F.count(F.lit(1)).alias("n"))


@query("landed_agreement", """WITH h AS (SELECT seq, vote FROM battles)
SELECT judge, mode, count(*) AS n, round(avg((human_vote = judge_vote)::INT), 6) AS agreement FROM judgments GROUP BY judge, mode""")
def landed_agreement(spark, sf):
    """Landed once as partitioned Parquet, then read with partition pruning."""
    path = fresh(spark, "landed")
    jsonl.land(view(spark, sf, "judgments"), path, ["judge", "mode"])
    rows = spark.read.parquet(path)
    return rows.groupBy("judge", "mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("human_vote") == F.col("judge_vote")).cast("int")), 6).alias("agreement"),
    )


@query("flattened_annotations", """SELECT 's' || seq AS chat_session_id, j.judge, m.mode, vote || j.judge AS judgment FROM battles,
 (VALUES ('jA'), ('jB')) j(judge), (VALUES ('with_execution'), ('without_execution')) m(mode)""")
def flattened_annotations(spark, sf):
    root = fresh(spark, "annotated")

    def verdict(judge):
        return F.struct(
            F.concat("vote", F.lit(judge)).alias("judgment"), F.lit("model").alias("judger_type"),
            F.lit("v1").alias("version"), F.lit("t").alias("timestamp"),
        )

    judges = F.map_from_arrays(F.array(F.lit("jA"), F.lit("jB")), F.array(verdict("jA"), verdict("jB")))
    feedback = F.map_from_arrays(
        F.array(F.lit("model_as_judge_unified"), F.lit("model_as_judge_unified_no_execution")), F.array(judges, judges)
    )
    rows = view(spark, sf, "battles").select(
        F.concat(F.lit("s"), F.col("seq").cast("string")).alias("chat_session_id"),
        F.col("model_a").alias("model_A"), F.col("model_b").alias("model_B"), feedback.alias("feedback"),
    )
    rows.write.json(root)
    read = spark.read.schema(jsonl.ANNOTATED).json(root)
    return jsonl.annotations(read).select("chat_session_id", "judge", "mode", "judgment")


MODELS = [f"m{i:02d}" for i in range(12)]


@query("model_answer_scan", """SELECT model, uid % 100 AS uid, arg_max(environment, uid) AS environment FROM executions GROUP BY ALL""")
def model_answer_scan(spark, sf):
    """Folder per model; of several lines for one uid the last one counts."""
    root = fresh(spark, "answers")
    rows = view(spark, sf, "executions").select(
        F.col("uid").alias("order"), (F.col("uid") % 100).cast("string").alias("uid"), "environment", "stderr", "model"
    )
    for model in MODELS:
        own = rows.filter(F.col("model") == model).orderBy("order")
        write_lines(own.drop("model", "order"), f"{root}/{model}/execution_results.jsonl")
    found = jsonl.model_answers(spark, root, "execution_results.jsonl")
    return found.select("model", F.col("uid").cast("bigint").alias("uid"), "environment")


@query("model_judgment_scan", """SELECT model, count(*) AS n, count(score2) AS complete FROM games GROUP BY model""")
def model_judgment_scan(spark, sf):
    root = fresh(spark, "judgments")
    games = view(spark, sf, "games").select(
        F.col("uid").cast("string").alias("uid"), F.lit("Vue").alias("environment"), "model",
        F.array(F.struct(F.col("score1").alias("score")), F.struct(F.col("score2").alias("score"))).alias("games"),
    )
    for model in MODELS:
        write_lines(games.filter(F.col("model") == model), f"{root}/{model}.jsonl")
    found = jsonl.model_judgments(spark, root)
    complete = F.try_element_at("games", F.lit(2))["score"]
    return found.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count(complete).alias("complete"))


@query("question_scan", "SELECT uid::VARCHAR AS uid, instruction, category FROM questions")
def question_scan(spark, sf):
    path = fresh(spark, "questions")
    view(spark, sf, "questions").select(F.col("uid").cast("string").alias("uid"), "instruction", "category").write.json(path)
    return jsonl.lines(spark, path)


@query("array_file_scan", "SELECT doc_id, lang, n_chars FROM documents")
def array_file_scan(spark, sf):
    """Files that hold one JSON array: here one per language."""
    path = fresh(spark, "arrays")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    body = F.array_join(F.collect_list(F.to_json(F.struct("doc_id", "lang", "n_chars"))), ",\n")
    block = F.floor(F.col("doc_id") / 500)
    docs.groupBy("lang", block).agg(F.concat(F.lit("[\n"), body, F.lit("\n]")).alias("value")).select(
        "value", "lang"
    ).write.partitionBy("lang").option("lineSep", "\n\n\n").option("maxRecordsPerFile", 1).text(path)
    schema = docs.schema
    return jsonl.array_file(spark, f"{path}/*/*.txt", schema)


@query("landed_question_scan", "SELECT uid::VARCHAR AS uid, instruction, category FROM questions")
def landed_question_scan(spark, sf):
    path = fresh(spark, "dataset")
    view(spark, sf, "questions").select(
        F.col("uid").cast("string").alias("uid"), "instruction", "category", F.length("instruction").alias("size")
    ).write.parquet(path)
    return jsonl.landed_questions(spark, path)


@query("generated_question_scan", """WITH q AS (SELECT category, uid, instruction FROM questions)
SELECT category AS file_category, instruction, row_number() OVER (ORDER BY category, uid) - 1 AS question_index FROM q""")
def generated_question_scan(spark, sf):
    root = fresh(spark, "generated")
    rows = view(spark, sf, "questions").select(
        F.col("uid").alias("order"), F.format_string("gen_%06d", F.col("uid")).alias("uid"), "instruction", "category",
        F.array(F.lit("s1")).alias("source_seeds"), F.lit("from_seed").alias("generation_method"),
    )
    for i in range(6):
        own = rows.filter(F.col("category") == f"cat{i}").orderBy("order").drop("order")
        write_lines(own, f"{root}/cat{i}_generated.jsonl")
    found = jsonl.generated_questions(spark, root)
    return found.select("file_category", "instruction", "question_index")


@query("seed_file_report", """SELECT 'cat' || i || '.jsonl' AS file, count(*) AS rows, CASE WHEN i = 2 THEN count(*) ELSE 0 END AS bad_rows, i <> 2 AS valid
FROM (SELECT doc_id % 6 AS i FROM documents) GROUP BY i""")
def seed_file_report(spark, sf):
    """One of the files lacks a required key in every row."""
    root = fresh(spark, "seeds")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("uid"), F.col("text").alias("instruction"),
        F.concat(F.lit("cat"), (F.col("doc_id") % 6).cast("string")).alias("category"),
    )
    for i in range(6):
        own = docs.filter(F.col("category") == f"cat{i}")
        write_lines(own.drop("category") if i == 2 else own, f"{root}/cat{i}.jsonl")
    return jsonl.seed_file_report(spark, f"{root}/*.jsonl")


@query("execution_summary_scan", f"""WITH {EXEC}, lv2 AS (SELECT * FROM lv)
SELECT model, level, value, count(*) AS total, count(*) FILTER (ok) AS success, round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate FROM lv2 GROUP BY ALL""")
def execution_summary_scan(spark, sf):
    """Nested summaries written per model and read back as rows."""
    root = fresh(spark, "summaries")
    summary = quality.execution_summary(view(spark, sf, "executions"), ["model"]).cache()

    def level(name):
        entry = F.struct(F.col("value"), F.struct("total", "success", "success_rate"))
        return F.map_from_entries(F.collect_list(F.when(F.col("level") == name, entry)))

    def overall(column):
        return F.max(F.when(F.col("level") == "overall", F.col(column)))

    nested = summary.groupBy("model").agg(
        overall("total").alias("total_executions"), overall("success").alias("successful"),
        overall("failed").alias("failed"), overall("success_rate").alias("success_rate"),
        level("environment").alias("by_environment"), level("category").alias("by_category"),
    )
    for model in MODELS:
        write_lines(nested.filter(F.col("model") == model).drop("model"), f"{root}/{model}/execution_summary.json")
    summary.unpersist()
    return rounded(jsonl.execution_summaries(spark, root), ["success_rate"])


# ------------------------------------------------------------------------ sinks

@query("pruned_copy", "SELECT doc_id, lang, source FROM documents")
def pruned_copy(spark, sf):
    path = fresh(spark, "pruned")
    sinks.write_pruned(table(spark, sf, "documents"), path, ["text", "n_chars"])
    return spark.read.schema("doc_id bigint, lang string, source string").json(path)


@query("category_folders", """SELECT category, lower(replace(replace(category, ' ', '_'), '/', '_')) AS folder, count(*) AS n FROM (
 SELECT 'Cat A/' || source AS category FROM documents WHERE text <> '') GROUP BY category""")
def category_folders(spark, sf):
    path = fresh(spark, "categories")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("uid"), F.col("text").alias("instruction"), F.concat(F.lit("Cat A/"), "source").alias("category")
    )
    sinks.write_by_category(rows, path)
    read = spark.read.schema("uid bigint, category string, safe_category string").json(path)
    return read.groupBy("category", F.col("safe_category").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("log_folders", """SELECT strftime(ts, '%Y_%m_%d') AS date, CASE WHEN user_id % 2 = 0 THEN 'battle_anony' ELSE 'direct' END AS chat_mode, count(*) AS n FROM events GROUP BY ALL""")
def log_folders(spark, sf):
    path = fresh(spark, "logs")
    rows = table(spark, sf, "events").select(
        "event_id", "ts", F.when(F.col("user_id") % 2 == 0, "battle_anony").otherwise("direct").alias("chat_mode")
    )
    sinks.write_logs(rows, path, "ts")
    read = spark.read.schema("event_id bigint, date string, chat_mode string").json(path)
    return read.groupBy("date", "chat_mode").agg(F.count(F.lit(1)).alias("n"))


@query("csv_export", f"""WITH {TASKS} SELECT uid, category, replace(replace(left(instruction, 150), chr(10), ' '), chr(13), '') || CASE WHEN length(instruction) > 150 THEN '...' ELSE '' END AS preview FROM tasks""")
def csv_export(spark, sf):
    path = fresh(spark, "csv")
    rows = tasks(spark, sf)
    sinks.write_csv(rows, path, ["uid", "category", "preview"])
    return spark.read.schema("uid string, category string, preview string").option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)


@query("report_export", f"""WITH {TASKS} SELECT t.category, t.uid, c.count, c.percentage FROM tasks t JOIN (SELECT category, count(*) AS count,
 round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tasks), 1) AS percentage FROM tasks GROUP BY category) c USING (category)""")
def report_export(spark, sf):
    path = fresh(spark, "report")
    sinks.write_report(tasks(spark, sf), path, ["uid", "instruction"])
    summary = spark.read.schema("category string, count bigint, percentage double").json(f"{path}/summary")
    members = spark.read.schema("uid string, group string").json(f"{path}/members")
    return members.withColumnRenamed("group", "category").join(summary, "category")


@query("split_outcomes", """SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS output, count(*) AS n,
 count(*) FILTER (event_type = 'error') AS with_error, count(*) FILTER (user_id % 3 = 0) AS backed_up,
 count(*) AS states FROM events GROUP BY 1""")
def split_outcomes(spark, sf):
    """A first run is backed up by a second one, which a retry then adds to."""
    path = fresh(spark, "outcome")
    rows = table(spark, sf, "events").select(
        "event_id", F.struct("user_id", "props").alias("state"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error at "), F.col("ts").cast("string"))).alias("error"),
    )
    half = F.col("state.user_id") % 2 == 0
    third = F.col("state.user_id") % 3 == 0
    sinks.write_outcome(rows.filter(third), f"{path}/ok", f"{path}/failed", "jA")
    backups = sinks.write_outcome(rows.filter(half), f"{path}/ok", f"{path}/failed", "jA")
    sinks.write_outcome(rows.filter(~half), f"{path}/ok", f"{path}/failed", "jA", retry=True)
    schema = "event_id bigint, state string, processing_error string"
    found = None
    for output, folder, backup in zip(("done", "failed"), (f"{path}/ok", f"{path}/failed"), backups):
        now = spark.read.schema(schema).json(folder).withColumn("old", F.lit(0))
        part = now.unionByName(spark.read.schema(schema).json(backup).withColumn("old", F.lit(1))).withColumn("output", F.lit(output))
        found = part if found is None else found.unionByName(part)
    current = F.col("old") == 0
    message = F.get_json_object("processing_error", "$.error_message")
    return found.groupBy("output").agg(
        F.count_if(current).alias("n"), F.count_if(current & message.startswith("error at")).alias("with_error"),
        F.count_if(~current).alias("backed_up"),
        F.count_if(current & F.get_json_object("state", "$.user_id").isNotNull()).alias("states"),
    )


@query("new_visual_files", """WITH f AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'svg' WHEN 2 THEN 'md' ELSE 'txt' END AS ext FROM pages)
SELECT CASE ext WHEN 'md' THEN 'markdown' ELSE ext END AS kind, count(DISTINCT html) AS n FROM f WHERE ext <> 'txt' GROUP BY 1""")
def new_visual_files(spark, sf):
    """Pages as files; files listed before the run and equal contents drop out."""
    path = fresh(spark, "visuals")
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("value"))
    kinds = {0: "html", 1: "svg", 2: "md", 3: "txt"}
    current = None
    for k, extension in kinds.items():
        part = pages.filter(F.col("page_id") % 4 == k)
        named = part.select(
            F.concat(F.lit(f"{path}/"), F.col("page_id").cast("string"), F.lit(f".{extension}")).alias("path"),
            F.encode("value", "UTF-8").alias("content"),
        )
        current = named if current is None else current.unionByName(named)
    current.write.parquet(path)
    files = spark.read.parquet(path)
    again = files.withColumn("path", F.concat(F.lit("x/"), "path"))  # same contents under other names
    old = files.withColumn("path", F.concat(F.lit("old/"), "path"))  # present before the run
    seen = old.select("path")
    out = sinks.new_visual_files(files.unionByName(again).unionByName(old), seen)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def write_files(rows, folder: str) -> None:
    """``rows(name, content)`` as one file each below ``folder``, a folder that all executors mount."""

    def write(part):
        import os

        for row in part:
            path = os.path.join(folder, row["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as out:
                out.write(row["content"])

    rows.foreachPartition(write)


EXTENSIONS = ("html", "SVG", "md", "txt")
RUN_FILES = """f AS (SELECT page_id, encode(coalesce(html, '')) AS content, (['html', 'SVG', 'md', 'txt'])[page_id % 4 + 1] AS ext FROM pages),
 late AS (SELECT 'out/' || page_id || '.' || ext AS name, ext, content FROM f WHERE page_id % 5 <> 0 UNION ALL
  SELECT 'out/deep/copy' || page_id || '.htm', 'htm', content FROM f WHERE page_id % 7 = 0)"""
SHOWN = "ext <> 'txt' AND octet_length(content) > 0"  # the scan lists no empty files


def run_files(spark, sf):
    """A run's folder as real files: a fifth of the pages before the run, the others and some copies after it."""
    root = fresh(spark, "run-files").removeprefix("file:")
    pages = table(spark, sf, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    extension = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("out/"), F.col("page_id").cast("string"), F.lit("."), extension)
    early = F.col("page_id") % 5 == 0
    write_files(pages.filter(early).select(name.alias("name"), "content"), f"{root}/files")
    files.write_snapshot(spark, f"{root}/files", f"{root}/before")
    write_files(pages.filter(~early).select(name.alias("name"), "content"), f"{root}/files")
    copies = pages.filter(F.col("page_id") % 7 == 0)
    copy = F.concat(F.lit("out/deep/copy"), F.col("page_id").cast("string"), F.lit(".htm"))
    write_files(copies.select(copy.alias("name"), "content"), f"{root}/files")
    return root


@query("visual_outputs", f"""WITH {RUN_FILES}
SELECT arg_min(name, name) AS name, CASE lower(arg_min(ext, name)) WHEN 'md' THEN 'markdown' WHEN 'htm' THEN 'html' ELSE lower(arg_min(ext, name)) END AS kind, sha256(content) AS digest
FROM late WHERE {SHOWN} GROUP BY content""")
def visual_outputs(spark, sf):
    """Files found in the folder that its snapshot before the run does not list."""
    root = run_files(spark, sf)
    out = files.visual_outputs(spark, f"{root}/files", f"{root}/before")
    return out.select(F.regexp_extract("path", r"/files/(.*)$", 1).alias("name"), "kind", "digest")


@query("file_changes", f"""WITH {RUN_FILES} SELECT 'added' AS change, count(*) AS n FROM late WHERE {SHOWN} HAVING count(*) > 0""")
def file_changes(spark, sf):
    """Listings before and after the run; no content is read."""
    root = run_files(spark, sf)
    out = files.changes(files.listing(spark, f"{root}/files"), files.snapshot(spark, f"{root}/before"))
    return out.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("agreement_from_files", """WITH h AS (SELECT 's' || seq AS chat_session_id, vote, category FROM battles)
SELECT j.judge, j.mode, count(*) AS n_samples, round(avg((CASE j.judgment WHEN 'vote_model_A' THEN 'vote_left' WHEN 'vote_model_B' THEN 'vote_right' ELSE j.judgment END = h.vote)::INT), 6) AS accuracy
FROM judge_rows j JOIN h USING (chat_session_id) WHERE j.judgment IN ('vote_model_A', 'vote_model_B', 'vote_tie', 'vote_both_bad') GROUP BY ALL""")
def agreement_from_files(spark, sf):
    """Scan, normalise, join and score in one go."""
    root = fresh(spark, "agreement")
    for judge, mode in JUDGES:
        write_lines(judge_lines(spark, sf, judge, mode), f"{root}/{judge}/{mode}/all.jsonl")
    human = view(spark, sf, "battles").select(
        F.concat(F.lit("s"), F.col("seq").cast("string")).alias("chat_session_id"), "vote",
        F.col("category").alias("category_name"), "seq",
    )
    human = battles.latest(human, ["chat_session_id"], "seq").drop("seq")
    cells = agreement.confusion_cells(agreement.matched_pairs(jsonl.judge_results(spark, root), human), ["judge", "mode"])
    return rounded(agreement.metrics(cells, ["judge", "mode"]), ["accuracy"]).select("judge", "mode", "n_samples", "accuracy")
