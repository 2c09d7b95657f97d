"""Registered queries: readers and sinks on files made from the tables (A), streaming (K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..operators import accuracy as acc
from ..session import settle, shared_folder
from ..sources import readers as rdr
from ..sources import sinks
from ..streaming import running
from .registry import query
from .view_sql import sql
from .views import clips, questions, raw_annotations, results, table


def fresh(spark, name):
    return f"{shared_folder(spark)}/io-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def documents_of(df, key, size=50):
    """Rows gathered into documents of about `size` rows by a hash of their key."""
    n = df.agg(F.ceil(F.count("*") / F.lit(float(size)))).scalar()
    return df.withColumn("_doc", hash_int(42, "doc", F.col(key)) % F.greatest(n, F.lit(1)))


@query("annotations_read_back", sql("""
select file_name clip, action, aggressor, victim, bystanders, environment from raw_annotations""", "raw"))
def annotations_read_back(spark, sf):
    """The raw records as lists, wrapped lists and single objects, one JSON value per line."""
    raw = raw_annotations(spark, sf)
    item = F.struct("file_name", "action", "aggressor", "victim", "environment", F.col("bystanders"))
    docs = documents_of(raw, "file_name").groupBy("_doc").agg(F.collect_list(item).alias("rows"))
    shape = F.col("_doc") % 3
    many = docs.filter(shape < 2).select(F.when(shape == 0, F.to_json("rows")).otherwise(
        F.to_json(F.struct(F.col("rows").alias("annotations")))).alias("value"))
    single = docs.filter(shape == 2).select(F.explode("rows").alias("r")).select(F.to_json("r").alias("value"))
    path = fresh(spark, "annotations")
    many.unionByName(single).write.text(path)
    return rdr.read_annotations(spark, path, multi_line=False).select(
        F.col("file_name").alias("clip"), "action", "aggressor", "victim", "bystanders", "environment")


@query("nested_annotations_read_back", sql("select file_name clip, action from raw_annotations", "raw"))
def nested_annotations_read_back(spark, sf):
    raw = raw_annotations(spark, sf)
    item = F.to_json(F.struct("file_name", "action"))
    docs = documents_of(raw, "file_name").groupBy("_doc").agg(F.collect_list(item).alias("rows"))
    half = F.floor(F.size("rows") / 2).cast("int")
    inner = F.concat(F.lit("["), F.array_join(F.slice("rows", F.lit(1), half), ","), F.lit("]"))
    parts = F.concat(F.array(inner, F.lit('"stray"'), F.lit("7")), F.slice("rows", half + 1, F.size("rows")))
    path = fresh(spark, "nested")
    docs.select(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("value")).write.text(path)
    return rdr.read_nested_annotations(spark, path, whole_files=False).select(F.col("file_name").alias("clip"), "action")


def _question_item(*more):
    return F.struct(
        F.col("clip").alias("video_name"), F.col("qtype").alias("question_type"), "is_secondary", "is_trick", "prompt",
        *more, "correct_answer", "correct_index", "option_hardness")


@query("bank_read_back", sql("""
select clip, qtype, is_trick, prompt, array_to_string(answers, ' ## ') answers, correct_answer, correct_index from questions""", "questions"))
def bank_read_back(spark, sf):
    """Half of the clips in map form, half as flat rows with the options under their other name."""
    q = questions(spark, sf)
    mapped = hash_int(42, "form", F.col("clip")) % 2 == 0
    per_clip = q.filter(mapped).groupBy("clip").agg(F.collect_list(_question_item("answers")).alias("qs"))
    docs = documents_of(per_clip, "clip", 20).groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("clip", "qs"))).alias("questions_by_video"))
    path = fresh(spark, "bank")
    docs.select("questions_by_video").write.mode("append").option("compression", "gzip").json(path)
    q.filter(~mapped).select(F.to_json(_question_item(F.col("answers").alias("all_answers"))).alias("value")).write.mode("append").option("compression", "gzip").text(path)
    back = rdr.read_bank(spark, [path], multi_line=False)
    return back.select("clip", "qtype", "is_trick", "prompt", F.array_join("answers", " ## ").alias("answers"), "correct_answer", "correct_index")


def _result_item():
    return F.struct(
        F.col("clip").alias("video_name"), F.col("qtype").alias("question_type"), "prompt", "correct_index",
        F.col("response").alias("model_response"), F.col("selected").alias("model_selected_index"), "is_correct", "error")


@query("results_read_back", sql("""
select qtype, count(*) total, count_if(is_correct) correct, count(selected) parsed from results where error is null group by 1""", "results"))
def results_read_back(spark, sf):
    """Answers in wrapped documents; rows without a score are left out by the reader."""
    r = results(spark, sf).withColumn("is_correct", F.when(F.col("error").isNull(), F.col("is_correct")))
    docs = documents_of(r.select("clip", _result_item().alias("item")), "clip", 400).groupBy("_doc").agg(F.collect_list("item").alias("results"))
    path = fresh(spark, "results")
    docs.select("results").write.json(path)
    back = rdr.read_results(spark, path, multi_line=False)
    return back.groupBy("qtype").agg(*acc.counts(), F.count("selected").alias("parsed"))


def _checkpoints(spark, sf, broken):
    """One line per clip in JSON files; with `broken`, every clip of group g_7 leaves a cut line."""
    path = fresh(spark, "checkpoints")
    r = results(spark, sf).filter("model = 'atlas-8b'")
    if broken:
        bad = clips(spark, sf).filter("group_id = 'g_7'").select("clip")
        bad.select(F.concat(F.lit('{"video_name": "'), "clip", F.lit('", "results": [')).alias("value")).write.mode("append").text(path)
    rows = r.select("clip", F.lit("2024-01-01T00:00:00").alias("timestamp"), F.col("qtype").alias("question_type"), "prompt", "correct_index",
                    F.col("response").alias("model_response"), F.col("selected").alias("model_selected_index"), "is_correct", "error")
    sinks.append_checkpoints(rows, path, "gzip")
    return path


@query("checkpoints_read_back", sql("""
select clip, qtype, is_correct, selected from results where model = 'atlas-8b'""", "results"))
def checkpoints_read_back(spark, sf):
    """Append-only lines, cut lines among them, read tolerantly."""
    return rdr.read_checkpoints(spark, _checkpoints(spark, sf, True)).select("clip", "qtype", "is_correct", "selected")


@query("checkpoint_bad_lines", sql("""
select (select count(*) from clips where group_id = 'g_7') bad_lines, count(distinct clip) good_lines from results where model = 'atlas-8b'""", "results"))
def checkpoint_bad_lines(spark, sf):
    per = rdr.bad_line_counts(spark, _checkpoints(spark, sf, True))
    return per.agg(F.sum("bad_lines").alias("bad_lines"), (F.sum("lines") - F.sum("bad_lines")).alias("good_lines"))


@query("checkpoints_all_or_nothing", sql("""
select qtype, count(*) total from results where model = 'atlas-8b' group by 1""", "results"))
def checkpoints_all_or_nothing(spark, sf):
    """Files without a bad line come through whole."""
    return rdr.read_checkpoints(spark, _checkpoints(spark, sf, True), on_bad="void").groupBy("qtype").agg(F.count("*").alias("total"))


@query("completed_clips", sql("select distinct clip from results where model = 'atlas-8b'", "results"))
def completed_clips(spark, sf):
    return rdr.completed_clips(spark, _checkpoints(spark, sf, False))


@query("parent_groups_read_back", sql("""
select clip, category, case when group_id like 'g_9%' then category || '/__solo__/' || clip else category || '/' || group_id end group_id from clips""", "clips"))
def parent_groups_read_back(spark, sf):
    """Group documents of about fifty clips each; groups g_9... are listed under no_group."""
    named = clips(spark, sf).select("clip", "category", F.when(F.col("group_id").startswith("g_9"), "no_group").otherwise(F.col("group_id")).alias("parent"))
    parents = documents_of(named, "clip").groupBy("_doc", "category", "parent").agg(F.collect_list("clip").alias("clips"))
    cats = parents.groupBy("_doc", "category").agg(F.map_from_entries(F.collect_list(F.struct("parent", "clips"))).alias("parents"))
    docs = cats.groupBy("_doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", "parents")))).alias("value"))
    path = fresh(spark, "groups")
    docs.select("value").write.text(path)
    return rdr.read_groups(spark, path, whole_files=False)


@query("log_accuracy", sql("""
select qtype, count(*) total, count_if(is_correct) correct from results where model = 'borea-7b' and error is null and selected is not null group by 1""", "results"))
def log_accuracy(spark, sf):
    """Worker logs from the answers: a clip line, then type and status lines; unparsed answers log
    a status without a type, and failed ones a type without a status."""
    r = results(spark, sf).filter("model = 'borea-7b'")
    typed = F.concat(F.lit("    Type: "), F.col("qtype"))
    status = F.concat(F.lit("[GPU 0]  Status:  "), F.when(F.col("is_correct"), "CORRECT").otherwise("WRONG"))
    note = F.when(F.col("error").isNotNull(), typed).when(F.col("selected").isNull(), status).otherwise(F.concat_ws("\n", typed, F.lit("   ..."), status))
    # a failed answer's open type is closed by the next clip line: it is logged last
    block = r.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct(F.col("error").isNotNull().alias("late"), F.col("qtype"), note.alias("t")))).alias("l"))
    text = F.concat(F.lit("[1/9] Processing "), F.col("clip"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    path = fresh(spark, "logs")
    block.select(text.alias("value")).write.option("compression", "gzip").text(path)
    return rdr.log_accuracy(spark, path).groupBy("qtype").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))


@query("summary_csv_read_back", sql("""
, a as (select model, round(count_if(is_correct and qtype = 'primary_action') * 100.0 / count_if(qtype = 'primary_action'), 2) pa,
   round(count_if(is_correct) * 100.0 / count(*), 2) ov from results group by 1)
select model, case when model like 'cirrus%' then 'below' else 'above' end part, pa as primary_action, case when model = 'borea-7b' then null else ov end overall from a""", "results"))
def summary_csv_read_back(spark, sf):
    """A wide summary with two lines above its header, percent signs, a blank row and a marker row."""
    per = results(spark, sf).groupBy("model").agg(
        F.round(F.count_if(F.col("is_correct") & (F.col("qtype") == "primary_action")) * 100.0 / F.count_if(F.col("qtype") == "primary_action"), 2).alias("pa"),
        F.round(F.count_if("is_correct") * 100.0 / F.count("*"), 2).alias("ov"))
    line = F.concat_ws(",", "model", F.concat(F.col("pa").cast("string"), F.lit("%")), F.when(F.col("model") == "borea-7b", "n.a.").otherwise(
        F.concat(F.col("ov").cast("string"), F.lit("%"))))
    body = per.agg(
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("model").startswith("cirrus"), line))), "\n").alias("above"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("model").startswith("cirrus"), line))), "\n").alias("below"))
    text = F.concat(F.lit("summary,,\n,,\nModel,primary_action,overall\n"), F.col("above"), F.lit("\n,,\nRole prompt,,\n"), F.col("below"))
    path = fresh(spark, "summary")
    body.select(text.alias("value")).coalesce(1).write.text(path)
    return rdr.read_summary_csv(spark, path)


@query("pipe_csv_read_back", "select o_orderkey, o_orderstatus, o_orderpriority from orders")
def pipe_csv_read_back(spark, sf):
    path = fresh(spark, "csv")
    sinks.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, sep="|")
    return spark.read.schema("o_orderkey bigint, o_orderstatus string, o_orderpriority string").option("header", True).option("sep", "|").csv(path)


@query("bank_metadata", sql("""
select count(*) num_questions, count(distinct clip) num_videos, count_if(qtype = 'primary_action') primary_action,
  count_if(qtype in ('compound_aggressor_action_victim', 'sequence_verification')) complex from questions""", "questions"))
def bank_metadata(spark, sf):
    path = fresh(spark, "document")
    sinks.write_bank(questions(spark, sf), path, version="2.0")
    meta = spark.read.text(f"{path}/metadata").select(F.from_json(
        "value", "num_questions bigint, num_videos bigint, question_counts_by_type map<string,bigint>, category_counts map<string,bigint>").alias("m"))
    return meta.select("m.num_questions", "m.num_videos", F.try_element_at("m.question_counts_by_type", F.lit("primary_action")).alias("primary_action"),
                       F.try_element_at("m.category_counts", F.lit("complex")).alias("complex"))


# --- K --------------------------------------------------------------------------------------------

def answer_stream(spark, sf, columns, files=2):
    """The named columns of the answers, written out as files and streamed a few files per batch."""
    kept = settle(results(spark, sf).select(*columns))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("running_accuracy", sql("""
select model, qtype, count(*) total, count_if(is_correct) correct, count(selected) parsed, count_if(is_correct) / count(*)::double accuracy,
  count(selected) / count(*)::double parsed_rate from results group by all""", "results"))
def running_accuracy(spark, sf):
    path = fresh(spark, "running")
    running.keep_latest(running.running_accuracy(answer_stream(spark, sf, ["model", "qtype", "is_correct", "selected"])), path, f"{path}-checkpoint").awaitTermination()
    return running.latest_totals(spark, path)


@query("answered_once", sql("select clip, prompt from results group by all", "results"))
def answered_once(spark, sf):
    """Four models answer every question; one answer per question goes through."""
    path = fresh(spark, "once")
    first = running.once_per_question(answer_stream(spark, sf, ["clip", "prompt"], 8))
    running.append_to(first, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema("clip string, prompt string").json(path)


@query("event_stream_counts", """
select event_type as model, props as qtype, count(*) total, count_if(value > 10) correct from events group by all""")
def event_stream_counts(spark, sf):
    """Event files as a stream: the running counts end at the batch result."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = events.select(F.col("event_type").alias("model"), F.col("props").alias("qtype"), (F.col("value") > 10).alias("is_correct"), F.col("event_id").alias("selected"))
    path = fresh(spark, "events")
    running.keep_latest(running.running_accuracy(rows), path, f"{path}-checkpoint").awaitTermination()
    return running.latest_totals(spark, path).select("model", "qtype", "total", "correct")
