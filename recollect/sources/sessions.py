"""Readers of session logs, fact batches, notes and snapshots; writers of snapshots and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text as tx

c = F.col
TURN = "type string, sessionId string, timestamp string, uuid string, parentUuid string, cwd string, gitBranch string, message struct<role: string, content: string>, toolUseResult struct<stdout: string, stderr: string, interrupted: boolean, isError: boolean>"
FACT = "content string, fact_type string, source_event_id long, scope string, base_importance double, metadata string, t_valid string, t_invalid string, pinned boolean, t_created string, last_accessed string"


def read_sessions(spark: SparkSession, path: str, line_bytes: int = 1 << 20) -> DataFrame:
    """Entries of JSON-lines logs under path, any depth; too long and malformed lines are left out. `position` has the order
    of a file's lines, as a file's splits are told by where they begin and rows of a split keep their order."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    turns = lines.where(F.octet_length("value") <= line_bytes).select(F.from_json("value", TURN).alias("t"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("position"))
    return turns.where("t.type is not null").select("t.*", "file", "position")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, description, type, date, body, fact_type, knowledge) of markdown notes. Without closed front matter the
    whole file is the body; the date is the front matter's, else the file name's, else when the file was written."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    raw = F.regexp_replace("value", "^\\x{FEFF}", "")
    front = r"(?s)^---\r?\n((?:(?:[ \t#\-][^\n]*|[^\n:]*:[^\n]*|\r?)\n)*?)---\r?(?:\n|$)"
    notes = whole.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written"), raw.alias("raw")).withColumn("head", F.regexp_extract("raw", front, 1))

    def field(*keys: str) -> Column:
        found = F.regexp_extract("head", rf"(?m)^[ \t]*(?:{'|'.join(keys)})[ \t]*:[ \t]*([^\r\n]*?)[ \t]*$", 1)
        return F.nullif(F.regexp_replace(found, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))

    dated = F.coalesce(F.try_to_timestamp(field("valid_from", "date", "created")), tx.file_date(F.col("file")).cast("timestamp"), "written")
    kind = F.lower(field("type"))
    return notes.select("file", field("name").alias("name"), field("description").alias("description"), kind.alias("type"), dated.alias("date"), tx.strip(F.regexp_replace("raw", front, "")).alias("body"), tx.note_class(kind).alias("f")).select(
        "file", "name", "description", "type", "date", "body", "f.*"
    )


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows of a JSON-lines batch: prior in [0, 1] and valid time in order."""
    rows = spark.read.schema(FACT).json(path).withColumns({n: F.try_to_timestamp(n).cast("timestamp_ntz") for n in ("t_valid", "t_invalid", "t_created", "last_accessed")})
    prior = F.coalesce("base_importance", F.lit(0.5))
    ok = c("content").isNotNull() & prior.between(0, 1) & ~F.isnan(prior) & (c("t_valid").isNull() | c("t_invalid").isNull() | (c("t_valid") < c("t_invalid")))
    return rows.where(ok), rows.where(~ok)


BLOCKS = "array<struct<type: string, text: string, thinking: string, name: string, input: string>>"
CALL = "struct<tool: string, command: string, stdout: string, stderr: string, interrupted: boolean>"


def reconstruct(entries: DataFrame) -> DataFrame:
    """(session_id, at, user_text, assistant_text, calls) of log entries (those of read_sessions, with `position`).

    A prompt is a user entry without a tool result. It meets the first assistant entry whose parent it is, else the first
    assistant entry before the next prompt that no other prompt has. Results meet an assistant's calls by their order.
    Entries without a uuid meet nothing; a prompt without a reply makes no turn.
    """
    blocks = F.from_json("message.content", BLOCKS)
    text = F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "thinking")), lambda b: F.coalesce(b["text"], b["thinking"])), "\n"), "message.content", F.lit(""))
    session = F.coalesce("sessionId", "file")
    rows = entries.where(c("type").isin("user", "assistant")).select(
        session.alias("session_id"), "position", "uuid", "parentUuid", F.try_to_timestamp("timestamp").alias("at"), "toolUseResult", text.alias("text"),
        ((c("type") == "user") & c("toolUseResult").isNull()).alias("prompt"), (c("type") == "assistant").alias("reply"),
        F.filter(blocks, lambda b: b["type"] == "tool_use").alias("uses"),
    )
    w = Window.partitionBy("session_id").orderBy("position")
    rows = rows.where("uuid <> ''").withColumn("part", F.count_if("prompt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prompts = rows.where("prompt").select("session_id", "part", "uuid", c("position").alias("p"), c("at").alias("prompt_at"), c("text").alias("user_text"))
    prompts = prompts.withColumn("again", F.row_number().over(Window.partitionBy("session_id", "uuid").orderBy("p"))).where("again = 1").drop("again")
    replies = rows.where("reply").select("session_id", "part", "position", c("uuid").alias("reply_uuid"), "parentUuid", c("at").alias("reply_at"), c("text").alias("assistant_text"), "uses")
    first = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "p").orderBy("position"))).where("n = 1").drop("n")
    linked = first(prompts.join(replies.drop("part").withColumnRenamed("parentUuid", "uuid"), ["session_id", "uuid"]))
    left = prompts.join(linked.select("session_id", "p"), ["session_id", "p"], "left_anti")
    free = replies.drop("parentUuid").join(linked.select("session_id", "reply_uuid"), ["session_id", "reply_uuid"], "left_anti")
    both = linked.unionByName(first(left.join(free, ["session_id", "part"]).where("position > p")))
    results = rows.where("toolUseResult is not null and parentUuid <> ''").groupBy("session_id", c("parentUuid").alias("reply_uuid"))
    results = results.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "toolUseResult"))), lambda r: r["toolUseResult"]).alias("results"))

    def call(use: Column, i: Column) -> Column:
        r = F.get("results", i)
        return F.struct(
            use["name"].alias("tool"), F.get_json_object(use["input"], "$.command").alias("command"), r["stdout"].alias("stdout"), r["stderr"].alias("stderr"), F.coalesce(r["interrupted"], F.lit(False)).alias("interrupted")
        )

    calls = F.coalesce(F.transform("uses", call), F.array().cast(f"array<{CALL}>"))
    return both.join(results, ["session_id", "reply_uuid"], "left").select("session_id", F.coalesce("prompt_at", "reply_at").alias("at"), c("p").alias("position"), "user_text", "assistant_text", calls.alias("calls"))


def session_outcomes(turns: DataFrame) -> DataFrame:
    """(session_id, outcome, has_commit, tests_passed, error_loop, interrupted, mood) of turns (those of reconstruct).

    An error loop is three calls in a row whose error output begins alike. A commit without one, or passed tests without
    an interruption at the end, is success; else a loop, an interruption or a negative last prompt is failure.
    """
    out = lambda x: F.lower(F.coalesce(x["stdout"], F.lit("")))
    commit = lambda x: (
        ((F.lower(x["tool"]) == "bash") & F.contains(F.lower(F.coalesce(x["command"], F.lit(""))), F.lit("git commit"))) | tx.has_any(out(x), ("[main", "[master")) | F.regexp_like(out(x), F.lit("[0-9a-f]{7}"))
    )
    passed = lambda x: F.contains(out(x), F.lit("test result: ok")) | (F.contains(out(x), F.lit("passed")) & F.contains(out(x), F.lit("test"))) | (F.contains(out(x), F.lit("pytest")) & F.contains(out(x), F.lit(" ok")))
    order = F.struct("at", "position")
    per = turns.groupBy("session_id").agg(
        F.bool_or(F.exists("calls", lambda x: F.coalesce(commit(x), F.lit(False)))).alias("has_commit"),
        F.bool_or(F.exists("calls", passed)).alias("tests_passed"),
        F.coalesce(F.max_by(F.get(F.col("calls"), F.size("calls") - 1)["interrupted"], F.when(F.size("calls") > 0, order)), F.lit(False)).alias("interrupted"),
        tx.mood(F.max_by("user_text", order)).alias("mood"),
    )
    calls = turns.select("session_id", "at", "position", F.posexplode("calls").alias("i", "x"))
    begun = calls.withColumn("e", F.nullif(F.substring(tx.strip(F.coalesce("x.stderr", F.lit(""))), 1, 100), F.lit("")))
    w = Window.partitionBy("session_id").orderBy("at", "position", "i")
    loops = begun.withColumn("loop", (c("e") == F.lag("e", 1).over(w)) & (c("e") == F.lag("e", 2).over(w))).groupBy("session_id").agg(F.coalesce(F.bool_or("loop"), F.lit(False)).alias("error_loop"))
    met = per.join(loops, "session_id", "left").withColumn("error_loop", F.coalesce("error_loop", F.lit(False)))
    won = (c("has_commit") & ~c("error_loop")) | (c("tests_passed") & ~c("interrupted"))
    lost = c("error_loop") | c("interrupted") | ((c("mood") == "negative") & ~c("has_commit"))
    return met.withColumn("outcome", F.when(won, "success").when(lost, "failure").otherwise("indeterminate"))


def extract_facts(turns: DataFrame, outcomes: DataFrame, most: int = 2000) -> DataFrame:
    """(session_id, at, category, matched_keywords, content, fact_type, importance, outcome): a fact for each category that
    a turn meets; contents are cut to `most` bytes."""
    stderr = F.array_join(F.transform("calls", lambda x: x["stderr"]), "\n")
    met = turns.withColumn("k", tx.keywords(c("user_text"), c("assistant_text"), stderr)).select("*", F.explode("k").alias("category", "matched_keywords"))
    said = lambda who, x: F.when(F.length(x) > 0, F.concat(F.lit(f"{who}: "), x))
    content = F.concat_ws("\n", said("User", c("user_text")), said("Assistant", c("assistant_text")))
    cut = F.pandas_udf(lambda s: s.map(lambda t: tx.cut_bytes(t, most, "...")), "string")
    return met.join(outcomes.select("session_id", "outcome"), "session_id").select(
        "session_id", "at", "category", "matched_keywords", cut(content).alias("content"), tx.fact_class(c("category"), c("outcome")).alias("f"), "outcome"
    ).select("session_id", "at", "category", "matched_keywords", "content", "f.*", "outcome")


def paired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, user_text, reply) of user turns and the next assistant turn of the conversation, if one follows."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    later = turns.withColumn("reply", F.first(F.when(c("role") == "assistant", F.coalesce("text", F.lit(""))), ignorenulls=True).over(w))
    return later.where((c("role") == "user") & c("reply").isNotNull()).select("conv_id", "turn", c("text").alias("user_text"), "reply")


def write_snapshot(tables: dict[str, DataFrame], path: str, compression: str = "zstd") -> None:
    """One parquet folder per table; the reader checks the version file that is written last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", compression).parquet(f"{path}/{name}")
    spark.createDataFrame([(1, sorted(tables))], "version int, tables array<string>").write.json(f"{path}/_snapshot")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    head = spark.read.schema("version int, tables array<string>").json(f"{path}/_snapshot").first()
    if head is None or head.version != 1:
        raise ValueError(f"{path} is no snapshot of version 1")
    return {name: spark.read.parquet(f"{path}/{name}") for name in head.tables}


def archive_manifest(chosen: DataFrame, least: int = 100) -> DataFrame:
    """One manifest row of the facts to archive, none below `least` facts."""
    row = chosen.agg(F.count(F.lit(1)).alias("fact_count"), F.min("id").alias("fact_id_min"), F.max("id").alias("fact_id_max"), F.min("t_created").alias("t_created_min"), F.max("t_created").alias("t_created_max"))
    return row.where(c("fact_count") >= least)


def verify_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of archive files, to hold against a manifest."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(c("path").alias("file"), c("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
