"""Log-like views of the given tables, in Spark and as SQL text.

Both sides build the same rows, so that a query and its SQL see the same input.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.session import configure, shared_dir, spread
from tracewell.streaming.tail import open_file_system

MESSAGE = """
  case {id} % 4
    when 0 then concat('Order ', cast({id} as {str}), ' failed for user ', cast(user_id as {str}))
    when 1 then concat('Connection refused to 10.0.', cast(user_id as {str}), '.1:5432 after ', cast({id} % 7 as {str}), ' retries')
    when 2 then concat('Timeout waiting for lock 0x', lpad(cast({id} as {str}), 8, '0'), ' at /var/lib/', cast(user_id as {str}), '.db')
    else concat('mail to user', cast(user_id as {str}), '@example.org bounced') end
"""
LEVEL = """
  case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'signup' then 'info'
    when 'click' then 'debug' else 'fatal' end
"""
RANK = "case level when 'trace' then 0 when 'debug' then 1 when 'info' then 2 when 'warn' then 3 when 'error' then 4 when 'fatal' then 5 else 6 end"
SPARK_ISO = """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")"""
DUCK_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    # A short event becomes a long line.
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), by_size=name == "events")


def as_entries(events: DataFrame) -> DataFrame:
    """``events`` as log entries; also used on streams."""
    message = MESSAGE.format(id="event_id", str="string")
    return events.selectExpr(
        "concat('e', lpad(cast(event_id as string), 12, '0')) as id", "event_id as seq", "ts as timestamp", "user_id",
        f"{SPARK_ISO} as iso", "concat('svc-', cast(user_id % 5 as string)) as service",
        "concat('src-', cast(user_id % 3 as string)) as source_id", f"{LEVEL} as level", f"{message} as message",
    ).selectExpr(
        "*", "concat(iso, ' ', message) as raw",
        "case when seq % 6 = 5 then array(concat('\tat com.example.Job.run(Job.java:', cast(seq % 97 as string), ')'), "
        "'Caused by: java.io.IOException') end as stacktrace",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_entries(table(spark, sf_dir, "events"))


ENTRIES_SQL = f"""
fx as (
  select *, concat(iso, ' ', message) as raw,
    case when seq % 6 = 5 then [concat(chr(9), 'at com.example.Job.run(Job.java:', cast(seq % 97 as varchar), ')'),
      'Caused by: java.io.IOException'] end as stacktrace,
    {RANK} as level_rank
  from (
    select concat('e', lpad(cast(event_id as varchar), 12, '0')) as id, event_id as seq, ts as "timestamp", user_id, {DUCK_ISO} as iso,
      concat('svc-', cast(user_id % 5 as varchar)) as service, concat('src-', cast(user_id % 3 as varchar)) as source_id,
      {LEVEL} as level, {MESSAGE.format(id="event_id", str="varchar")} as message
    from events))
"""

# Masks of the fingerprint in SQL; 'g' replaces all matches.
_MASKS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*", "<TIMESTAMP>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<IP>"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "<EMAIL>"),
    (r"\b0x[0-9a-fA-F]{4,}\b", "<HEX>"),
    (r"""/(?:tmp|var|home|users|root)/[^\s"'']+""", "<PATH>"),
    (r"\b\d+\b", "<N>"),
)


def template_sql(message: str) -> str:
    for pattern, mask in _MASKS:
        message = f"regexp_replace({message}, '{pattern}', '{mask}', 'g')"
    return f"trim({message})"


def fingerprint_sql(template: str) -> str:
    return f"substr(sha256({template}), 1, 16)"


CLUSTERED_SQL = f"""{ENTRIES_SQL},
masked as (select *, {template_sql("message")} as template from fx),
clustered as (select *, {fingerprint_sql("template")} as cluster_id from masked)
"""


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as an entry."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "message"))
    return lines.where("message <> ''").selectExpr(
        "concat('d', lpad(cast(doc_id as string), 10, '0'), '-', lpad(cast(pos as string), 6, '0')) as id",
        "doc_id * 100000 + pos as seq", "source as source_id", "lang as service",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 10000 as int), pos) as timestamp",
        "case (doc_id + pos) % 7 when 0 then 'trace' when 1 then 'debug' when 2 then 'info' when 3 then 'warn' "
        "when 4 then 'error' when 5 then 'fatal' else 'unknown' end as level",
        "message", "message as raw",
    )


DOCUMENTS_SQL = f"""
doc_lines as (
  select doc_id, lang, source, unnest(string_split(text, chr(10))) as message, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents),
dx as (
  select *, {RANK} as level_rank from (
  select concat('d', lpad(cast(doc_id as varchar), 10, '0'), '-', lpad(cast(pos as varchar), 6, '0')) as id,
    doc_id * 100000 + pos as seq, source as source_id, lang as service,
    timestamp '2024-01-01 00:00:00' + (doc_id % 10000) * interval 1 minute + pos * interval 1 second as "timestamp",
    case (doc_id + pos) % 7 when 0 then 'trace' when 1 then 'debug' when 2 then 'info' when 3 then 'warn'
      when 4 then 'error' when 5 then 'fatal' else 'unknown' end as level,
    message, message as raw
  from doc_lines where message <> ''))
"""

DEPOT = r"^(?P<timestamp>\S+) <(?P<level>\w+)> (?P<service>[\w-]+) => (?P<message>.*)$"

_TEXT = """
  case seq % 6
    when 0 then concat('{{"timestamp":"', iso, '","level":"', level, '","service":"', service, '","message":"', message, '"}}')
    when 1 then concat('time=', iso, ' level=', level, ' service=', service, ' msg="', message, '"')
    when 2 then concat(iso, ' ', upper(level), ' [', service, '] ', message)
    when 3 then concat(iso, ' <', upper(level), '> ', service, ' => ', message)
    when 4 then concat('{{"log":"', message, '","stream":"stdout","time":"', iso, '"}}')
    else concat(iso, ' ', upper(level), ' [', service, '] ', message, {nl}, {tab}, 'at com.example.Job.run(Job.java:',
      cast(seq % 97 as {str}), ')', {nl}, 'Caused by: java.io.IOException') end
"""


def as_lines(fx: DataFrame) -> DataFrame:
    """Entries as raw lines of six formats; the last one has continuation lines."""
    text = _TEXT.format(nl="chr(10)", tab="chr(9)", str="string")
    return (
        fx.selectExpr("seq", "source_id", "timestamp", f"{text} as txt")
        .select("source_id", F.lit("app.log").alias("file"), "seq", "timestamp", F.posexplode(F.split("txt", "\n")).alias("pos", "value"))
        .selectExpr("source_id", "file", "seq * 10 + pos as line_no", "value", "timestamp + interval 1 hour as ingested_at")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(entries(spark, sf_dir))


LINES_SQL = f"""{ENTRIES_SQL},
texts as (select seq, source_id, "timestamp", {_TEXT.format(nl="chr(10)", tab="chr(9)", str="varchar").replace("{{", "{").replace("}}", "}")} as txt from fx),
lx as (
  select source_id, 'app.log' as file, seq * 10 + pos as line_no, value, "timestamp" + interval 1 hour as ingested_at, seq
  from (select *, unnest(string_split(txt, chr(10))) as value, generate_subscripts(string_split(txt, chr(10)), 1) - 1 as pos from texts))
"""


def write_logs(lines: DataFrame, folder: str, until: int | None) -> None:
    """One log file for each source, with its lines below number ``until`` and the first letters of the next one.

    A later call with a higher number leaves files that begin alike, as if the rest had been appended.
    """
    def write(batches):
        system, root = open_file_system(folder)
        name, file, torn = None, None, False
        for batch in batches:
            names, numbers, values = (column.to_pylist() for column in batch.columns)
            low = 0
            while low < len(names):
                if names[low] != name:
                    if file is not None:
                        file.close()
                    name, torn = names[low], False
                    file = system.open_output_stream(f"{root}/{name}.log")
                high = bisect.bisect_right(names, name, low)
                end = high if until is None else bisect.bisect_left(numbers, until, low, high)
                if end > low:
                    file.write(("\n".join(values[low:end]) + "\n").encode())
                if end < high and not torn:
                    file.write(values[end][:5].encode())
                    torn = True
                low = high
            yield batch.slice(0, 0)
        if file is not None:
            file.close()

    system, root = open_file_system(folder)
    system.create_dir(root)
    ordered = lines.select("source_id", "line_no", "value").repartition("source_id").sortWithinPartitions("source_id", "line_no")
    ordered.mapInArrow(write, ordered.schema).write.format("noop").mode("overwrite").save()


def write_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The lines as files of a fresh folder, some with blanks at the end, some blank; the folder."""
    folder = shared_dir(spark, "logs")
    value = F.when(F.col("line_no") % 110 == 0, "  ").when(F.col("line_no") % 70 == 0, F.concat("value", F.lit("  "))).otherwise(F.col("value"))
    write_logs(lines(spark, sf_dir).withColumn("value", value), folder, None)
    return folder


# The same lines with the numbers that a reader of the files gives them.
FILES_SQL = f"""{LINES_SQL},
fl as (select source_id as name, row_number() over (partition by source_id order by line_no) - 1 as line_no,
  case when line_no % 110 = 0 then '  ' when line_no % 70 = 0 then value || '  ' else value end as value from lx)"""


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of every page as an entry."""
    return table(spark, sf_dir, "pages").selectExpr("concat('p', page_id) as id", "page_id as seq", "coalesce(url, '') as message")


PAGES_SQL = f"""px as (select page_id as seq, {template_sql("coalesce(url, '')")} as template from pages),
pf as (select *, {fingerprint_sql("template")} as fingerprint from px),
pt as (select fingerprint, min(template) as template, min(seq) as seq, row_number() over (order by min(seq)) as i from pf group by fingerprint),
near as (select a.i as later, b.i as earlier, 1.0::double - levenshtein(a.template, b.template) / greatest(length(a.template), length(b.template))::double as score
  from pt a join pt b on b.i < a.i and least(length(a.template), length(b.template)) >= 0.85 * greatest(length(a.template), length(b.template)) - 1e-9),
similar_to as (select * from near where score >= 0.85::double)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of :func:`lines`; two of three use the custom line format."""
    return entries(spark, sf_dir).select("source_id").distinct().selectExpr(
        "source_id", "concat('App ', source_id) as label", "case when source_id <> 'src-2' then 'depot' end as parser_hint",
        "source_id <> 'src-1' as enabled",
    )


def as_burst(fx: DataFrame) -> DataFrame:
    """Entries whose errors of one day fall into one and a half seconds."""
    moved = (
        "timestamp_ntz'2024-01-15 12:00:00' + make_dt_interval(0, 0, 0, "
        "cast(case when seq % 10 = 0 then 1500 else seq % 900 end as decimal(18,6)) / 1000)"
    )
    return fx.withColumn("timestamp", F.expr(f"case when level = 'error' and day(timestamp) = 15 then {moved} else timestamp end"))


def burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_burst(entries(spark, sf_dir))


BURST_SQL = f"""{ENTRIES_SQL},
bx as (
  select * replace (case when level = 'error' and day("timestamp") = 15
    then timestamp '2024-01-15 12:00:00' + (case when seq % 10 = 0 then 1500 else seq % 900 end) * interval 1 millisecond
    else "timestamp" end as "timestamp")
  from fx)
"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers derived from the entries, in all the shapes answers come in."""
    return entries(spark, sf_dir).selectExpr("id as entry_id", "timestamp", "level", "service", f"{_REPLY.format(str='string')} as reply")


_REPLY = """
  case seq % 5
    when 0 then concat('{{"what":"', message, '","why":"load","impact":"', service, '","debug_steps":["check ', source_id, '","retry"],"possible_causes":["',
      level, '"],"fix_suggestions":[{{"step":7,"title":"Restart","description":"', service, '","command":"restart"}}],"confidence":0.25}}')
    when 1 then concat('Here is the result: {{"what":"', message, '","debug_steps":["a",1,"b"],"confidence":0.75}} Hope it helps.')
    when 2 then concat('{{"what":7,"title":"T ', service, '","root_cause":"', message, '","overview":"', level, '","evidence":["', source_id,
      '"],"fix_suggestions":[{{"title":"x"}},{{"description":"y","code":"z"}}],"key_issues":["k1","k2"]}}')
    when 3 then concat('no answer for ', message)
    else concat('broken {{"what": ', message, '}}') end
"""

REPLIES_SQL = f"""{ENTRIES_SQL},
rx as (select id as entry_id, "timestamp", level, service, {_REPLY.format(str="varchar").replace("{{", "{").replace("}}", "}")} as reply from fx),
answers as (
  select entry_id, try_cast(nullif(regexp_extract(reply, '(?s)\\{{.*\\}}', 0), '') as json) as a from rx),
ok as (select * from answers where a is not null)
"""
