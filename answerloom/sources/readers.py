"""Readers for annotation, bank, result, checkpoint, group, log and summary files.

Person fields are read as text, so that a string, list or number arrives as it was written.
Document files are one JSON value per file (`multi_line=True`) or one per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.ranking import running_total, sorted_ordinal

ANNOTATION = (
    "file_name string, video_name string, action string, aggressor string, aggressors string, victim string, "
    "victims string, bystander string, bystanders string, environment string, outcome string, note string")
QUESTION = (
    "video_name string, question_type string, is_secondary boolean, is_trick boolean, prompt string, "
    "answers array<string>, all_answers array<string>, correct_answer string, correct_index int, option_hardness array<string>")
RESULT = QUESTION + ", model_response string, model_selected_index int, is_correct boolean, error string"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _json(spark: SparkSession, paths, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(paths)


def read_annotations(spark: SparkSession, paths, multi_line: bool = True, strict: bool = False) -> DataFrame:
    """A1. A top-level list, {"annotations": [...]}, or one object (not when strict); else an error."""
    fields = _names(ANNOTATION)
    docs = _json(spark, paths, f"{ANNOTATION}, annotations array<struct<{_struct(ANNOTATION)}>>", multi_line)
    own = F.struct(*fields)
    known = F.coalesce(F.col("file_name"), F.col("video_name")).isNotNull()
    stop = F.raise_error(F.lit("not an annotation list")).cast(f"array<struct<{_struct(ANNOTATION)}>>")
    items = F.when(F.col("annotations").isNotNull(), F.col("annotations")).when(known, F.array(own)).otherwise(stop)
    rows = docs.select(F.explode(items).alias("a"))
    return rows.select("a.*")


def _struct(schema: str) -> str:
    return ", ".join(f"{p.split()[0]}: {p.split(' ', 1)[1]}" for p in schema.split(", "))


def read_nested_annotations(spark: SparkSession, paths, whole_files: bool = True) -> DataFrame:
    """A15. A list whose entries may be lists themselves; entries that are no objects are dropped."""
    text = spark.read.option("wholetext", whole_files).text(paths)
    outer = text.select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    inner = F.when(F.ltrim("item").startswith("["), F.from_json("item", "array<string>")).otherwise(F.array("item"))
    flat = outer.select(F.explode(inner).alias("item")).filter(F.ltrim("item").startswith("{"))
    return flat.select(F.from_json("item", ANNOTATION).alias("a")).select("a.*")


def _question_columns(prefix: str = ""):
    c = lambda n: F.col(prefix + n)
    return [
        c("question_type").alias("qtype"), F.coalesce(c("is_secondary"), F.lit(False)).alias("is_secondary"),
        F.coalesce(c("is_trick"), F.lit(False)).alias("is_trick"), c("prompt"), F.coalesce(c("answers"), c("all_answers")).alias("answers"),
        c("correct_answer"), c("correct_index"), c("option_hardness")]


def read_bank(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    """A2. A bank in map form {"questions_by_video": {...}} or as a flat list.

    `question_index` is the position in the clip's list; a flat list has none.
    """
    item = f"array<struct<{_struct(QUESTION)}>>"
    docs = _json(spark, paths, f"{QUESTION}, questions_by_video map<string, {item}>", multi_line)
    mapped = docs.select(F.explode("questions_by_video").alias("clip", "qs")).select("clip", F.posexplode("qs").alias("question_index", "q"))
    mapped = mapped.select("clip", "question_index", *_question_columns("q."))
    flat = docs.filter(F.col("questions_by_video").isNull() & F.col("question_type").isNotNull()).select(
        F.col("video_name").alias("clip"), F.lit(None).cast("int").alias("question_index"), *_question_columns())
    return mapped.unionByName(flat)


def read_results(spark: SparkSession, paths, multi_line: bool = True, keep_unscored: bool = False) -> DataFrame:
    """A3. {"results": [...]} or a bare list; the file's name gives the model. Rows without a clip,
    a prompt or a score are left out unless `keep_unscored`."""
    fields = _names(RESULT)
    docs = _json(spark, paths, f"{RESULT}, results array<struct<{_struct(RESULT)}>>", multi_line)
    docs = docs.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_combined)?\.", 1).alias("model"))
    items = F.coalesce("results", F.array(F.struct(*fields)))
    rows = docs.select("model", F.explode(items).alias("r")).select(
        "model", F.col("r.video_name").alias("clip"), *_question_columns("r."), F.col("r.model_response").alias("response"),
        F.col("r.model_selected_index").alias("selected"), "r.is_correct", "r.error")
    if keep_unscored:
        return rows
    return rows.filter((F.coalesce("clip", F.lit("")) != "") & (F.coalesce("prompt", F.lit("")) != "") & F.col("is_correct").isNotNull())


CHECKPOINT = f"video_name string, timestamp string, num_questions int, completed boolean, results array<struct<{_struct(RESULT)}>>"


def checkpoint_lines(spark: SparkSession, paths) -> DataFrame:
    """A4/A6. Every checkpoint line with its file; `bad` marks lines that do not parse."""
    lines = spark.read.schema(CHECKPOINT + ", _corrupt_record string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    bad = F.col("_corrupt_record").isNotNull() | F.col("video_name").isNull()
    return lines.select(F.col("_metadata.file_path").alias("file"), bad.alias("bad"), "video_name", "timestamp", "num_questions",
                        "completed", "results")


def read_checkpoints(spark: SparkSession, paths, on_bad: str = "skip") -> DataFrame:
    """A4/A5. Results of the good lines. 'skip' leaves bad lines out; 'void' leaves out every file
    that has one, and keeps completed clips only."""
    lines = checkpoint_lines(spark, paths)
    good = lines.filter(~F.col("bad"))
    if on_bad == "void":
        broken = lines.groupBy("file").agg(F.bool_or("bad").alias("_broken")).filter("_broken")
        good = good.join(broken, "file", "left_anti").filter(F.coalesce("completed", F.lit(True)))
    elif on_bad != "skip":
        raise ValueError(f"unknown on_bad {on_bad!r}")
    return good.select("file", F.col("video_name").alias("clip"), "timestamp", F.explode("results").alias("r")).select(
        "file", "clip", "timestamp", *_question_columns("r."), F.col("r.model_response").alias("response"),
        F.col("r.model_selected_index").alias("selected"), "r.is_correct", "r.error")


def bad_line_counts(spark: SparkSession, paths) -> DataFrame:
    """A4."""
    return checkpoint_lines(spark, paths).groupBy("file").agg(
        F.count("*").alias("lines"), F.count_if("bad").alias("bad_lines"))


def completed_clips(spark: SparkSession, paths) -> DataFrame:
    """A6."""
    return checkpoint_lines(spark, paths).filter("not bad").select(F.col("video_name").alias("clip")).distinct()


def read_groups(spark: SparkSession, paths, whole_files: bool = True) -> DataFrame:
    """A7. {category: {parent | "no_group": [clip]}} as (clip, category, group_id); solo clips get their own group."""
    text = spark.read.option("wholetext", whole_files).text(paths)
    cats = text.select(F.explode(F.from_json("value", "map<string, map<string, array<string>>>")).alias("category", "parents"))
    clips = cats.select("category", F.explode("parents").alias("parent", "clips")).select("category", "parent", F.explode("clips").alias("clip"))
    solo = F.concat_ws("/", F.col("category"), F.lit("__solo__"), F.col("clip"))
    return clips.select("clip", "category", F.when(F.col("parent") == "no_group", solo).otherwise(
        F.concat_ws("/", "category", "parent")).alias("group_id"))


def log_accuracy(spark: SparkSession, paths) -> DataFrame:
    """A8/H7. Accuracy per file and type from worker logs.

    A status counts when a type was named since the last clip line or status. The lines between
    two such marks form a segment; segments are numbered by a distributed running count, and each
    is summed up as a group, so that one huge log is still many tasks.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")
    v = F.col("value")
    got = lambda pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
    clip = v.rlike(r"\[\d+/\d+\]\s+Processing\s+\S+")
    kind, status = F.when(~clip, got(r"Type:\s+(\S+)")), F.when(~clip, got(r"Status:\s+(CORRECT|WRONG)"))
    marked = lines.select("file", "block", "line", kind.alias("type"), F.when(kind.isNull(), status).alias("status"),
                          clip.alias("is_clip"))
    marked = marked.filter("type is not null or status is not null or is_clip").withColumn(
        "ends", (F.col("is_clip") | F.col("status").isNotNull()).cast("bigint"))
    numbered = running_total(marked, [F.col("file"), F.col("block"), F.col("line")], "ends", "_upto")
    segment = F.col("_upto") - F.col("ends")
    summed = numbered.groupBy("file", segment.alias("segment")).agg(
        F.max_by("type", F.when(F.col("type").isNotNull(), F.struct("block", "line"))).alias("qtype"), F.max("status").alias("status"))
    known = summed.filter("qtype is not null and status is not null")
    return known.groupBy("file", "qtype").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "CORRECT").alias("correct"))


def read_summary_csv(spark: SparkSession, path: str, marker: str = "Role prompt") -> DataFrame:
    """A9. A wide summary whose header is its third line: percent signs go, cells become numbers,
    rows without a model go, and the rows below the marker row form the second part."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    placed = sorted_ordinal(lines, ["block", "line"], "no")
    header = [h.strip() for h in placed.filter("no = 2").first()["value"].split(",")]
    names = ["model", *header[1:]]
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = placed.filter("no > 2").select("no", F.from_csv("value", F.lit(schema)).alias("r")).select("no", "r.*")
    at = cells.filter(F.trim("model") == marker).agg(F.min("no")).scalar()
    part = F.when(F.col("no") > at, "below").otherwise("above")
    kept = cells.filter((F.coalesce(F.trim("model"), F.lit("")) != "") & (F.trim("model") != marker))
    numbers = [F.regexp_replace(F.col(f"`{n}`"), "%", "").try_cast("double").alias(n) for n in names[1:]]
    return kept.select("model", part.alias("part"), *numbers)


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """A10. Names of the media files in a folder; their content is not read."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("clip"))
    return files.filter(F.lower("clip").rlike(r"\.(" + "|".join(K.MEDIA_EXTENSIONS) + ")$"))


def find_shards(spark: SparkSession, folder: str, stem: str, suffix: str = ".json") -> list[str]:
    """A11. The exact file when it is there, else its parts in name order."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"{stem}*{suffix}").load(folder).select("path")
    found = sorted(r["path"] for r in names.collect())  # file names only
    exact = [p for p in found if p.rsplit("/", 1)[-1] == f"{stem}{suffix}"]
    return exact or [p for p in found if p.rsplit("/", 1)[-1].startswith(f"{stem}_part")]
