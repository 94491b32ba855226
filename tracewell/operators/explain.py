"""Tables before and after a model call: prompts, parsed answers, cached answers.

The model itself is a function handed in by the caller, see :func:`ask_model`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tracewell.functions.levels import level_label
from tracewell.operators.clusters import cluster_samples
from tracewell.schema import FIX_STEP

RAW_SHOWN = 500
BLOCK_SAMPLE = 20
CLUSTER_SAMPLE = 5
DEFAULT_CONFIDENCE = 0.5
DEFAULT_TITLE = "Root Cause Analysis"

_ANSWER = "Answer with one JSON object and nothing else, with the keys: "
_EXPLAIN_KEYS = "what, why, impact (texts), debug_steps, possible_causes, fix_suggestions (lists of texts), confidence (0 to 1)."
_SUMMARY_KEYS = "overview (text), key_issues, patterns, root_causes, recommendations (lists of texts)."
_ROOT_CAUSE_KEYS = (
    "title, root_cause (texts), evidence, contributing_factors (lists of texts), fix_suggestions (list of objects with "
    "step, title, description and optionally command, code), confidence (0 to 1)."
)


def iso_utc(ts: Column) -> Column:
    """RFC 3339 text of a UTC time."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("")))


def explain_prompts(entries: DataFrame) -> DataFrame:
    """``entry_id, prompt``: one request per entry."""
    prompt = _lines(
        "Explain this log entry to the engineer on duty.",
        _labelled("Time", iso_utc(F.col("timestamp"))),
        _labelled("Level", level_label(F.col("level"))),
        _labelled("Service", F.coalesce("service", F.lit("unknown"))),
        _labelled("Message", F.col("message")),
        # concat_ws leaves the trace out where there is none.
        F.when(F.size("stacktrace") > 0, F.concat(F.lit("Stack trace:\n"), F.array_join("stacktrace", "\n"))),
        _labelled("Raw line", F.substring("raw", 1, RAW_SHOWN)),
        _ANSWER + _EXPLAIN_KEYS,
    )
    return entries.select(F.col("id").alias("entry_id"), prompt.alias("prompt"))


def block_summary(entries: DataFrame, block: Column, sample: int = BLOCK_SAMPLE) -> DataFrame:
    """Per block: number of entries, first and last time, counts per level, newest sample lines.

    ``block`` is the grouping expression, such as a time window's start or a
    source. Counts are combined before the shuffle and samples cut to size there,
    so a block may hold any number of entries.
    """
    entries = entries.withColumn("block", block)
    levels = entries.groupBy("block", "level").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end")
    )
    totals = levels.groupBy("block").agg(
        F.sum("n").alias("entry_count"), F.min("start").alias("time_range_start"), F.max("end").alias("time_range_end"),
        F.array_sort(F.collect_list(F.struct("level", "n"))).alias("_levels"),
    )
    newest = W.partitionBy("block").orderBy(F.col("timestamp").desc(), "id")
    line = F.concat(
        F.lit("["), level_label(F.col("level")), F.lit("] "), F.coalesce("service", F.lit("-")), F.lit(" "), F.col("message")
    )
    lines = (
        entries.select("block", "timestamp", "id", "level", "service", "message")
        .withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= sample)
        .groupBy("block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("sample"))
    )
    return totals.join(lines, "block").select(
        "block", "entry_count", "time_range_start", "time_range_end",
        F.map_from_entries("_levels").alias("severity_distribution"),
        F.array_join(
            F.transform("_levels", lambda x: F.concat(level_label(x["level"]), F.lit("="), x["n"].cast("string"))), ", "
        ).alias("levels"),
        "sample",
    )


def summary_prompts(blocks: DataFrame) -> DataFrame:
    """``block, prompt`` of the rows of :func:`block_summary`."""
    prompt = _lines(
        "Summarise this block of log entries for the team that runs the system.",
        F.concat(F.lit("Time range: "), iso_utc(F.col("time_range_start")), F.lit(" to "), iso_utc(F.col("time_range_end"))),
        _labelled("Entries", F.col("entry_count")), _labelled("Levels", F.col("levels")),
        F.concat(F.lit(f"Sample, newest first, at most {BLOCK_SAMPLE}:\n"), F.array_join("sample", "\n")),
        _ANSWER + _SUMMARY_KEYS,
    )
    return blocks.select("block", prompt.alias("prompt"))


def root_cause_prompts(clusters: DataFrame, entries: DataFrame, samples: int = CLUSTER_SAMPLE) -> DataFrame:
    """``cluster_id, prompt``: one request per cluster, with its newest messages."""
    messages = (
        cluster_samples(entries, clusters, samples).groupBy("cluster_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))),
                         lambda x: F.concat(F.lit("- "), x["message"])).alias("_messages"))
    )
    prompt = _lines(
        "Find the root cause of this group of similar log entries.",
        _labelled("Template", F.col("template")), _labelled("Occurrences", F.col("count")),
        _labelled("Level", level_label(F.col("level"))), _labelled("Services", F.array_join("services", ", ")),
        _labelled("First seen", iso_utc(F.col("first_seen"))), _labelled("Last seen", iso_utc(F.col("last_seen"))),
        F.concat(F.lit("Sample messages:\n"), F.coalesce(F.array_join("_messages", "\n"), F.lit(""))),
        _ANSWER + _ROOT_CAUSE_KEYS,
    )
    return clusters.join(messages, "cluster_id", "left").select("cluster_id", prompt.alias("prompt"))


def ask_model(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Add ``reply`` by calling ``model`` on batches of prompts inside the tasks."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())])

    def call(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(reply=model(list(batch["prompt"])))

    return prompts.mapInPandas(call, schema)


def _answer(reply: Column) -> Column:
    """The outermost braces of a reply as a variant; null if they are no JSON object."""
    return F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))


def _typed(value: Column, name: str) -> Column:
    """A text member of a variant object, null unless it is a text."""
    member = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def _text(value: Column, name: str, default: str = "") -> Column:
    return F.coalesce(_typed(value, name), F.lit(default))


def _array(value: Column, name: str) -> Column:
    none = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "array<variant>"), none)


def _texts(value: Column, name: str) -> Column:
    """The text members of a list; anything else gives an empty list."""
    only = F.filter(_array(value, name), lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(only, lambda v: F.try_variant_get(v, "$", "string"))


def _confidence(value: Column) -> Column:
    member = F.try_variant_get(value, "$.confidence", "variant")
    number = F.when(
        F.schema_of_variant(member).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(value, "$.confidence", "double")
    )
    return F.coalesce(number, F.lit(DEFAULT_CONFIDENCE)).cast("float")


def _parsed(replies: DataFrame) -> DataFrame:
    """Replies with their answer; those without a JSON object are left out."""
    found = replies.withColumn("_answer", _answer(F.col("reply")))
    return found.select("*", F.explode(F.when(F.col("_answer").isNotNull(), F.array("_answer"))).alias("_a")).drop("_answer")


def parse_explanations(replies: DataFrame, keep=("entry_id",)) -> DataFrame:
    """Fields of explanation answers. Missing texts are empty, missing lists empty, missing confidence 0.5."""
    a = F.col("_a")
    return _parsed(replies).select(
        *keep, *[_text(a, n).alias(n) for n in ("what", "why", "impact")],
        *[_texts(a, n).alias(n) for n in ("debug_steps", "possible_causes", "fix_suggestions")],
        _confidence(a).alias("confidence"),
    )


def parse_summaries(replies: DataFrame, keep=("block",)) -> DataFrame:
    """Fields of block summaries; ``tokens_used`` is the sum where both counts are known."""
    a = F.col("_a")
    tokens = (F.col("input_tokens") + F.col("output_tokens")) if "input_tokens" in replies.columns else F.lit(None)
    return _parsed(replies).select(
        *keep, _text(a, "overview").alias("overview"),
        *[_texts(a, n).alias(n) for n in ("key_issues", "patterns", "root_causes", "recommendations")],
        tokens.cast("int").alias("tokens_used"),
    )


def parse_root_causes(replies: DataFrame, keep=("cluster_id",)) -> DataFrame:
    """Fields of root-cause answers; a step without a number gets its position."""
    a = F.col("_a")

    def step(v: Column, i: Column) -> Column:
        number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.step", "variant")) == "BIGINT",
                        F.try_variant_get(v, "$.step", "int"))
        return F.struct(
            F.coalesce(number, i + 1).cast("int").alias("step"), _text(v, "title").alias("title"),
            _text(v, "description").alias("description"), _typed(v, "command").alias("command"),
            _typed(v, "code").alias("code"),
        )

    return _parsed(replies).select(
        *keep, _text(a, "title", DEFAULT_TITLE).alias("title"), _text(a, "root_cause").alias("root_cause"),
        _texts(a, "evidence").alias("evidence"), _texts(a, "contributing_factors").alias("contributing_factors"),
        F.transform(_array(a, "fix_suggestions"), step).cast(T.ArrayType(FIX_STEP)).alias("fix_suggestions"),
        _confidence(a).alias("confidence"),
    )


def latest_explanation(explanations: DataFrame) -> DataFrame:
    """The newest stored explanation of each entry; ties by id."""
    others = [c for c in explanations.columns if c not in ("entry_id", "created_at", "id")]
    newest = explanations.groupBy("entry_id").agg(F.max_by(F.struct("created_at", "id", *others), F.struct("created_at", "id")).alias("e"))
    return newest.select("entry_id", "e.*")


def explanation_cache(entries: DataFrame, explanations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their stored explanation, and entries that still need one."""
    latest = latest_explanation(explanations).withColumnRenamed("id", "explanation_id").withColumnRenamed("entry_id", "id")
    return entries.join(latest, "id"), entries.join(latest.select("id"), "id", "left_anti")


