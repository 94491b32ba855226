"""The registered queries: name -> DataFrame function and, where SQL can say it, the SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tracewell.functions import formats, levels, text
from tracewell.functions.times import rfc3339
from tracewell.operators import clusters as C, explain as X, queries as Q, search_index as I, timeline as T
from tracewell.operators.assemble import merge_stacktraces
from tracewell.operators.correlation import service_correlation
from tracewell.operators.fuzzy import cluster_fuzzy, distinct_templates, similar_pairs
from tracewell.operators.normalize import normalize_lines
from tracewell.operators.parsers import (
    LineTemplate, compile_templates, only_parsed, parse_container_envelope, parse_custom, parse_json, parse_kv, parse_plaintext,
)
from tracewell.operators.plugins import ParserPlugin, PluginRegistry, normalize_with_plugins
from tracewell.operators.spikes import detect_spikes, error_rate, sample_ticks
from tracewell.plans import fixtures as fx
from tracewell.plans.fixtures import (
    BURST_SQL, CLUSTERED_SQL, DOCUMENTS_SQL, ENTRIES_SQL, FILES_SQL, LINES_SQL, PAGES_SQL, REPLIES_SQL, fingerprint_sql, template_sql,
)
from tracewell.sinks import export as EX, tables as S
from tracewell.session import shared_dir
from tracewell.sources import files as R
from tracewell.sources.files import load_sources, tail_lines
from tracewell.streaming import operators as ST
from tracewell.streaming.assemble import assemble_stream
from tracewell.streaming.ingest import close_pending, ingest, read_feed, store_batch
from tracewell.streaming.sources import stream_log_files
from tracewell.streaming.tail import follow_log_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FROM, TO = "2024-01-10 00:00:00", "2024-01-20 12:00:00"
TEMPLATES = (LineTemplate("depot", "Depot", fx.DEPOT),)
DAY15 = ("2024-01-15 00:00:00", "2024-01-16 00:00:00")


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def joined(column: str, separator: str = "|") -> Column:
    return F.array_join(column, separator).alias(column)


def clustered(spark, sf) -> DataFrame:
    return C.cluster_exact(fx.entries(spark, sf))


def summary(spark, sf) -> DataFrame:
    return C.cluster_summary(clustered(spark, sf))


# ---------------------------------------------------------------- filters and search

ENTRY = ["id", "timestamp", "level", "service", "source_id", "message"]
ENTRY_SQL = 'id, "timestamp", level, service, source_id, message'


@query("filter_time_range", f"""with {ENTRIES_SQL} select {ENTRY_SQL} from fx
  where "timestamp" >= timestamp '{FROM}' and "timestamp" <= timestamp '{TO}'""")
def _(spark, sf):
    return Q.filter_entries(fx.entries(spark, sf), from_time=FROM, to_time=TO).select(*ENTRY)


@query("filter_levels_services", f"""with {ENTRIES_SQL} select {ENTRY_SQL} from fx
  where level in ('error', 'warn') and service in ('svc-1', 'svc-3') and source_id = 'src-0' and regexp_matches(message, 'lock|retries')""")
def _(spark, sf):
    return Q.filter_entries(fx.entries(spark, sf), levels=("error", "warn"), services=("svc-1", "svc-3"),
                            source_ids=("src-0",), pattern="lock|retries").select(*ENTRY)


@query("filter_stacktrace_false", f"with {ENTRIES_SQL} select {ENTRY_SQL} from fx where level = 'warn'")
def _(spark, sf):
    # Only a true value restricts.
    return Q.filter_entries(fx.entries(spark, sf), levels=("warn",), has_stacktrace=False).select(*ENTRY)


@query("filter_has_stacktrace", f"with {ENTRIES_SQL} select {ENTRY_SQL} from fx where stacktrace is not null")
def _(spark, sf):
    return Q.filter_entries(fx.entries(spark, sf), has_stacktrace=True).select(*ENTRY)


@query("filter_cluster", f"with {CLUSTERED_SQL} select {ENTRY_SQL}, cluster_id from clustered where cluster_id = {fingerprint_sql(chr(39) + 'mail to <EMAIL> bounced' + chr(39))}")
def _(spark, sf):
    wanted = F.substring(F.sha2(F.lit("mail to <EMAIL> bounced"), 256), 1, 16)
    e = clustered(spark, sf)
    return e.where(F.col("cluster_id") == wanted).select(*ENTRY, "cluster_id")


@query("page_newest", f'with {ENTRIES_SQL} select {ENTRY_SQL} from fx order by "timestamp" desc, id limit 200 offset 400')
def _(spark, sf):
    return Q.page(fx.entries(spark, sf), offset=400).select(*ENTRY)


@query("sort_ascending", f'with {ENTRIES_SQL} select {ENTRY_SQL} from fx order by "timestamp", id limit 200')
def _(spark, sf):
    return Q.page(fx.entries(spark, sf), descending=False).select(*ENTRY)


@query("page_counts", f"""with {ENTRIES_SQL} select count(*) as total_matches, least(greatest(count(*) - 400, 0), 200) as returned
  from fx where level = 'error'""")
def _(spark, sf):
    return Q.page_counts(Q.filter_entries(fx.entries(spark, sf), levels=("error",)), 200, 400)


# Words of a document line as the SQL side sees them: lower case, no accents.
RUN = "concat(' ', regexp_replace(strip_accents(lower(message)), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'), ' ')"
WORDS_SQL = f"{DOCUMENTS_SQL}, wx as (select *, string_split({RUN}, ' ') as words, {RUN} as run from dx)"
FOUND = ["id", "timestamp", "source_id", "message"]
FOUND_SQL = 'id, "timestamp", source_id, message'


@query("search_all_terms", f"with {WORDS_SQL} select {FOUND_SQL} from wx where list_contains(words, 'the') and list_contains(words, 'and')")
def _(spark, sf):
    return Q.search_entries(fx.document_entries(spark, sf), "The AND", columns=("message",)).select(*FOUND)


@query("search_accents", f"with {WORDS_SQL} select {FOUND_SQL} from wx where list_contains(words, 'ete') or list_contains(words, 'fur')")
def _(spark, sf):
    return Q.search_entries(fx.document_entries(spark, sf), any_of="Été fur", columns=("message",)).select(*FOUND)


@query("search_any_none", f"""with {WORDS_SQL} select {FOUND_SQL} from wx
  where (list_contains(words, 'les') or list_contains(words, 'sch')) and not list_contains(words, 'la')""")
def _(spark, sf):
    return Q.search_entries(fx.document_entries(spark, sf), any_of="les sch", none_of="la", columns=("message",)).select(*FOUND)


@query("search_phrase", f"with {WORDS_SQL} select {FOUND_SQL} from wx where contains(run, ' of the ')")
def _(spark, sf):
    return Q.search_entries(fx.document_entries(spark, sf), phrase="of, THE", columns=("message",)).select(*FOUND)


@query("search_prefix", f"with {WORDS_SQL} select {FOUND_SQL} from wx where contains(run, ' eni')")
def _(spark, sf):
    return Q.search_entries(fx.document_entries(spark, sf), prefix="Éni", columns=("message",)).select(*FOUND)


@query("search_column", f"""with {ENTRIES_SQL} select {ENTRY_SQL} from fx
  where service = 'svc-2' and regexp_matches(message, '\\bconnection\\b|\\bConnection\\b')""")
def _(spark, sf):
    e = fx.entries(spark, sf)
    return e.where(Q.search_condition("svc-2", columns=("service",)) & Q.search_condition("connection", columns=("message",))).select(*ENTRY)


@query("search_with_filter", f"""with {ENTRIES_SQL} select {ENTRY_SQL} from fx
  where level = 'error' and "timestamp" >= timestamp '{FROM}' and regexp_matches(message, 'Timeout') order by "timestamp" desc, id limit 200""")
def _(spark, sf):
    found = Q.search_entries(fx.entries(spark, sf), "timeout", Q.EntryFilter(levels=("error",), from_time=FROM))
    return Q.page(found).select(*ENTRY)


@query("search_ranked", f"""with {WORDS_SQL} select id, count(*) as term_frequency from (select id, unnest(words) as w from wx) where w = 'the' group by id""")
def _(spark, sf):
    found = Q.search_entries(fx.document_entries(spark, sf), "the", columns=("message",))
    return found.select("id", Q.term_frequency(["the"], ("message",)).cast("long").alias("term_frequency"))


@query("search_token_index", f"with {WORDS_SQL} select {FOUND_SQL} from wx where list_contains(words, 'ete') or (list_contains(words, 'the') and list_contains(words, 'of'))")
def _(spark, sf):
    e = fx.document_entries(spark, sf)
    index = Q.build_token_index(e, ("message",))
    return Q.search_token_index(index, e, "the of").select(*FOUND).unionByName(
        Q.search_token_index(index, e, "Été").select(*FOUND)).distinct()


def document_index(spark, sf) -> DataFrame:
    """An index of the document lines, made by two batches of which the second is repeated."""
    e, path = fx.document_entries(spark, sf), shared_dir(spark, "index")
    for batch in (0, 1, 1):
        I.add_to_index(e.where(F.col("seq") % 2 == batch), path, batch, ("message",))
    return I.read_index(spark, path)


@query("index_phrase", SQL["search_phrase"])
def _(spark, sf):
    return I.search_index(document_index(spark, sf), fx.document_entries(spark, sf), phrase="of, THE").select(*FOUND)


@query("index_prefix", SQL["search_prefix"])
def _(spark, sf):
    return I.search_index(document_index(spark, sf), fx.document_entries(spark, sf), prefix="Éni").select(*FOUND)


@query("index_any_none", SQL["search_any_none"])
def _(spark, sf):
    return I.search_index(document_index(spark, sf), fx.document_entries(spark, sf), any_of="les sch", none_of="la").select(*FOUND)


@query("index_ranked", SQL["search_ranked"])
def _(spark, sf):
    return I.index_matches(document_index(spark, sf), "the").withColumnRenamed("occurrences", "term_frequency")


@query("highlight_matches", f"""with {ENTRIES_SQL} select id,
  regexp_replace(message, '\\b([Ff]ailed|[Rr]etries)\\b', '<mark>\\1</mark>', 'g') as highlighted from fx""")
def _(spark, sf):
    return Q.with_highlights(fx.entries(spark, sf), "failed retries").select("id", "highlighted")


@query("live_filter", f"""with {ENTRIES_SQL}, newest as (select * from fx order by seq desc limit 5000)
  select {ENTRY_SQL} from newest where level in ('error', 'fatal') and contains(lower(message), 'refused')""")
def _(spark, sf):
    return Q.live_filter(fx.entries(spark, sf), ("error", "fatal"), "REFUSED").select(*ENTRY)


@query("watch_min_level", f"""with {ENTRIES_SQL} select id, strftime("timestamp", '%H:%M:%S.%g') as "time",
  concat(upper(substr(level, 1, 1)), substr(level, 2)) as level, coalesce(service, '-') as service, message,
  list_aggregate(stacktrace[1:5], 'string_agg', '|') as stacktrace from fx where level_rank >= 3""")
def _(spark, sf):
    return Q.watch_view(fx.entries(spark, sf), "warn").withColumn("stacktrace", F.array_join("stacktrace", "|"))


def explanations(spark, sf) -> DataFrame:
    """Stored explanations of some entries, several for some of them."""
    copies = fx.entries(spark, sf).where("seq % 3 = 0").select("*", F.explode(F.expr("sequence(0, cast(seq % 2 as int))")).alias("copy"))
    return copies.selectExpr(
        "concat(id, '-', cast(copy as string)) as id", "id as entry_id", "timestamp + make_dt_interval(0, copy) as created_at",
        "concat('what ', message) as what", "cast(0.5 as float) as confidence",
    )


EXPLANATIONS_SQL = f"""{ENTRIES_SQL}, copies as (select *, unnest(range(0, seq % 2 + 1)) as copy from fx where seq % 3 = 0),
  ex as (select concat(id, '-', cast(copy as varchar)) as id, id as entry_id, "timestamp" + copy * interval 1 hour as created_at,
    concat('what ', message) as what, 0.5 as confidence from copies)"""


@query("errors_to_explain", f"with {EXPLANATIONS_SQL} select {ENTRY_SQL} from fx where level_rank >= 4 and id not in (select entry_id from ex)")
def _(spark, sf):
    return Q.errors_to_explain(fx.entries(spark, sf), explanations(spark, sf)).select(*ENTRY)


@query("latest_explanation", f"""with {EXPLANATIONS_SQL} select entry_id, id, created_at, what from ex
  qualify row_number() over (partition by entry_id order by created_at desc, id desc) = 1""")
def _(spark, sf):
    return X.latest_explanation(explanations(spark, sf)).select("entry_id", "id", "created_at", "what")


@query("explanation_cache", f"""with {EXPLANATIONS_SQL} select f.id, max_by(e.what, e.created_at) as what from fx f left join ex e on e.entry_id = f.id group by f.id""")
def _(spark, sf):
    cached, missing = X.explanation_cache(fx.entries(spark, sf), explanations(spark, sf))
    return cached.select("id", "what").unionByName(missing.select("id", F.lit(None).cast("string").alias("what")))


@query("store_explanations", f"""with {EXPLANATIONS_SQL}, changed as (select id, entry_id, created_at, concat('new ', what) as what from ex where right(id, 1) = '1')
  select id, entry_id, created_at, what from changed union all select id, entry_id, created_at, what from ex where id not in (select id from changed)""")
def _(spark, sf):
    stored = explanations(spark, sf).drop("confidence")
    changed = stored.where("endswith(id, '1')").withColumn("what", F.concat(F.lit("new "), "what"))
    return S.merge_explanations(stored, changed)


# ---------------------------------------------------------------- levels

@query("parse_level", f"""with {ENTRIES_SQL}, spelled as (select id, case seq % 8 when 0 then concat('[', upper(level), ']') when 1 then level when 2 then ' WARNING: '
    when 3 then 'E' when 4 then 'Crit' when 5 then 'dbg.' when 6 then 'information' else service end as spelling from fx),
  bare as (select id, spelling, regexp_replace(lower(spelling), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') as b from spelled),
  named as (select id, spelling, case when b in ('debug','dbg','d') then 'debug' when b in ('info','information','i') then 'info' when b in ('warn','warning','w') then 'warn'
    when b in ('error','err','e') then 'error' when b in ('fatal','critical','crit','f') then 'fatal' when b = 'trace' then 'trace' else 'unknown' end as level from bare)
  select id, spelling, level, {fx.RANK} as level_rank, case level when 'unknown' then 2 else {fx.RANK} end as level_score from named""")
def _(spark, sf):
    spelled = fx.entries(spark, sf).selectExpr("id", """case seq % 8 when 0 then concat('[', upper(level), ']') when 1 then level when 2 then ' WARNING: '
        when 3 then 'E' when 4 then 'Crit' when 5 then 'dbg.' when 6 then 'information' else service end as spelling""")
    named = spelled.withColumn("level", levels.parse_level(F.col("spelling")))
    return named.withColumn("level_rank", levels.level_rank(F.col("level"))).withColumn("level_score", levels.level_score(F.col("level")))


# ---------------------------------------------------------------- clusters

@query("fingerprint_entries", f"with {CLUSTERED_SQL} select id, template, cluster_id as fingerprint from clustered")
def _(spark, sf):
    return C.with_fingerprint(fx.entries(spark, sf)).select("id", "template", "fingerprint")


DOC_CLUSTERED_SQL = f"""{DOCUMENTS_SQL}, masked as (select *, {template_sql("message")} as template from dx),
  clustered as (select *, {fingerprint_sql("template")} as cluster_id from masked)"""


@query("fingerprint_document_lines", f"with {DOC_CLUSTERED_SQL} select id, cluster_id as fingerprint from clustered")
def _(spark, sf):
    return C.with_fingerprint(fx.document_entries(spark, sf)).select("id", "fingerprint")


@query("cluster_exact", f"with {DOC_CLUSTERED_SQL} select cluster_id, count(*) as entries from clustered group by cluster_id")
def _(spark, sf):
    return C.cluster_exact(fx.document_entries(spark, sf)).groupBy("cluster_id").agg(F.count("*").alias("entries"))


def summary_sql(base: str) -> str:
    return f"""{base},
  firsts as (select cluster_id, source_id, min(seq) as s from clustered group by all),
  services as (select cluster_id, service, min(seq) as s from clustered where service is not null group by all),
  samples as (select cluster_id, id, seq from clustered qualify row_number() over (partition by cluster_id order by seq, id) <= 5),
  summary as (
    select c.cluster_id, min_by(template, seq) as template, max(level_rank) as level_rank, count(*) as count, min("timestamp") as first_seen,
      max_by("timestamp", seq) as last_seen,
      (select string_agg(source_id, '|' order by s) from firsts f where f.cluster_id = c.cluster_id) as source_ids,
      (select string_agg(id, '|' order by seq) from samples f where f.cluster_id = c.cluster_id) as sample_ids,
      (select string_agg(service, '|' order by s) from services f where f.cluster_id = c.cluster_id) as services
    from clustered c group by c.cluster_id),
  named as (select *, ['trace','debug','info','warn','error','fatal','unknown'][level_rank + 1] as level from summary)"""


SUMMARY_SQL = summary_sql(CLUSTERED_SQL)
SUMMARY = ["cluster_id", "template", "level", "count", "first_seen", "last_seen", "source_ids", "sample_ids", "services"]


def flat_summary(clusters: DataFrame) -> DataFrame:
    return clusters.select(*SUMMARY[:6], joined("source_ids"), joined("sample_ids"), joined("services"))


@query("cluster_summary", f"with {SUMMARY_SQL} select {', '.join(SUMMARY)} from named")
def _(spark, sf):
    return flat_summary(summary(spark, sf))


@query("cluster_summary_documents", f"with {summary_sql(DOC_CLUSTERED_SQL)} select {', '.join(SUMMARY)} from named")
def _(spark, sf):
    return flat_summary(C.cluster_summary(C.cluster_exact(fx.document_entries(spark, sf))))


@query("list_clusters", f"with {DOC_CLUSTERED_SQL} select cluster_id, count(*) as count from clustered group by cluster_id order by count desc, cluster_id limit 50")
def _(spark, sf):
    return C.list_clusters(C.cluster_summary(C.cluster_exact(fx.document_entries(spark, sf)))).select("cluster_id", "count")


@query("top_errors", f"with {SUMMARY_SQL} select {', '.join(SUMMARY)} from named where level_rank >= 4 order by count desc, cluster_id limit 3")
def top_errors(spark, sf):
    return flat_summary(C.top_errors(summary(spark, sf), 3))


@query("clusters_view", f"""with {SUMMARY_SQL} select cluster_id, count, concat(upper(substr(level, 1, 1)), substr(level, 2)) as level,
  strftime(first_seen, '%m-%d %H:%M:%S') as first_seen, substr(template, 1, 60) as template,
  list_aggregate(string_split(services, '|')[1:3], 'string_agg', '|') as services from named order by count desc, cluster_id limit 20""")
def _(spark, sf):
    return C.clusters_view(summary(spark, sf)).withColumn("services", F.array_join("services", "|"))


@query("cluster_stats", f"""with {SUMMARY_SQL} select count(*) as total_clusters, sum(count)::bigint as total_entries,
  (select string_agg(concat(level, '=', cast(n as varchar)), '|' order by level) from (select level, sum(count)::bigint as n from named group by level)) as by_level,
  (select string_agg(cluster_id, '|' order by count desc, cluster_id) from (select * from named where level_rank >= 4 order by count desc, cluster_id limit 10)) as top_errors
  from named""")
def _(spark, sf):
    stats = C.cluster_stats(summary(spark, sf))
    pairs = F.transform(F.map_entries("by_level"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.select("total_clusters", "total_entries", F.array_join(pairs, "|").alias("by_level"), joined("top_errors"))


@query("find_cluster_prefix", f"with {DOC_CLUSTERED_SQL} select cluster_id, count(*) as count from clustered where starts_with(cluster_id, 'a') group by cluster_id order by count desc, cluster_id limit 1")
def _(spark, sf):
    return C.find_cluster(C.cluster_summary(C.cluster_exact(fx.document_entries(spark, sf))), "a").select("cluster_id", "count")


@query("cluster_samples", f"""with {DOC_CLUSTERED_SQL} select cluster_id, id, row_number() over (partition by cluster_id order by "timestamp" desc, id) as rank
  from clustered qualify rank <= 5""")
def _(spark, sf):
    return C.cluster_samples(C.cluster_exact(fx.document_entries(spark, sf))).select("cluster_id", "id", F.col("rank").cast("long").alias("rank"))


@query("upsert_clusters", f"""with {SUMMARY_SQL}, early as (select * from clustered where "timestamp" < timestamp '{TO}')
  select n.cluster_id, n.template, coalesce(e.level, n.level) as level, n.count, coalesce(e.first_seen, n.first_seen) as first_seen, n.last_seen from named n
  left join (select cluster_id, ['trace','debug','info','warn','error','fatal','unknown'][max(level_rank) + 1] as level, min("timestamp") as first_seen
    from early group by cluster_id) e on e.cluster_id = n.cluster_id""")
def _(spark, sf):
    e = clustered(spark, sf)
    stored = C.cluster_summary(e.where(F.col("timestamp") < F.lit(TO).cast("timestamp_ntz")))
    return S.merge_clusters(stored, C.cluster_summary(e)).select(*SUMMARY[:6])


@query("similar_pairs", f"""with {PAGES_SQL} select a.template as later, b.template as earlier, round(score, 9) as score
  from similar_to join pt a on a.i = later join pt b on b.i = earlier""")
def _(spark, sf):
    templates = distinct_templates(C.with_fingerprint(fx.page_entries(spark, sf))).select(
        F.col("seq").alias("tid"), "seq", "template", F.char_length("template").alias("len"))
    named = lambda side: templates.select(F.col("tid").alias(side), F.col("template").alias(f"{side}_template"))
    found = similar_pairs(templates, templates).join(named("later"), "later").join(named("earlier"), "earlier")
    return found.select(F.col("later_template").alias("later"), F.col("earlier_template").alias("earlier"), F.round("score", 9).alias("score"))


@query("cluster_fuzzy_pages", f"""with recursive {PAGES_SQL},
  lead(i, leaders) as (select 0::bigint, []::bigint[] union all
    select lead.i + 1, case when exists (select 1 from similar_to s where s.later = lead.i + 1 and list_contains(leaders, s.earlier)) then leaders else leaders || [lead.i + 1] end
    from lead where lead.i < (select max(i) from pt)),
  chosen as (select unnest(leaders) as i from (select leaders from lead order by i desc limit 1)),
  best as (select later, arg_max(earlier, [score, -earlier]) as leader from similar_to where earlier in (from chosen) and later not in (from chosen) group by later),
  members as (select i, i as leader from chosen union all select later, leader from best)
  select l.fingerprint as cluster_id, l.template, count(*) as entries, count(distinct t.fingerprint) as templates
  from members m join pt t on t.i = m.i join pt l on l.i = m.leader join pf on pf.fingerprint = t.fingerprint group by all""")
def _(spark, sf):
    e = cluster_fuzzy(fx.page_entries(spark, sf))
    return e.groupBy("cluster_id", "template").agg(F.count("*").alias("entries"), F.count_distinct("fingerprint").alias("templates"))


@query("cluster_fuzzy")
def _(spark, sf):
    e = cluster_fuzzy(fx.document_entries(spark, sf))
    return e.groupBy("cluster_id", "template").agg(F.count("*").alias("entries"), F.count_distinct("fingerprint").alias("templates"))


# ---------------------------------------------------------------- time

BUCKET = "time_bucket(interval 5 minutes, \"timestamp\", timestamp '1970-01-01 00:00:00')"


@query("timeline_buckets", f"""with {ENTRIES_SQL} select {BUCKET} as bucket, level, count(*) as count from fx
  where "timestamp" >= timestamp '{FROM}' and "timestamp" <= timestamp '{TO}' group by all""")
def _(spark, sf):
    return T.timeline_levels(fx.entries(spark, sf), FROM, TO)


@query("timeline_map", f"""with {ENTRIES_SQL}, cells as (select {BUCKET} as bucket, level, count(*) as n from fx group by all)
  select bucket, sum(n)::bigint as total, string_agg(concat(level, '=', cast(n as varchar)), '|' order by level) as by_level from cells group by bucket""")
def _(spark, sf):
    pairs = F.transform(F.map_entries("by_level"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return T.timeline(fx.entries(spark, sf)).select("bucket", "total", F.array_join(pairs, "|").alias("by_level"))


@query("timeline_pivot", f"""with {ENTRIES_SQL} select {BUCKET} as bucket, count(*) filter (level = 'error') as error, count(*) filter (level = 'warn') as warn,
  count(*) filter (level = 'info') as info, count(*) as total from fx
  where "timestamp" >= timestamp '2024-01-17 12:00:00' and "timestamp" <= timestamp '{TO}' group by all""")
def _(spark, sf):
    return T.timeline_pivot(fx.entries(spark, sf), *T.last_hours(72, TO))


@query("block_summary", f"""with {ENTRIES_SQL}, blocked as (select *, time_bucket(interval 1 day, "timestamp") as block from fx),
  levels as (select block, level, count(*) as n from blocked group by all),
  newest as (select *, row_number() over (partition by block order by "timestamp" desc, id) as rank from blocked qualify rank <= 20)
  select block, count(*) as entry_count, min("timestamp") as time_range_start, max("timestamp") as time_range_end,
    (select string_agg(concat(upper(substr(level, 1, 1)), substr(level, 2), '=', cast(n as varchar)), ', ' order by level) from levels l where l.block = b.block) as levels,
    (select string_agg(concat('[', upper(substr(level, 1, 1)), substr(level, 2), '] ', service, ' ', message), chr(10) order by rank) from newest n where n.block = b.block) as sample
  from blocked b group by block""")
def _(spark, sf):
    blocks = X.block_summary(fx.entries(spark, sf), F.date_trunc("day", "timestamp").cast("timestamp_ntz"))
    return blocks.drop("severity_distribution").withColumn("sample", F.array_join("sample", "\n"))


RATES = """rates as (select id, seq, "timestamp", service,
  count(*) over (order by us range between 60000000 preceding and current row)
    - (count(*) over (partition by us) - row_number() over (partition by us order by seq, id)) as rate, us
  from (select *, epoch_us("timestamp") as us from {source} where level_rank >= 4))"""


@query("error_rate_60s", f"with {BURST_SQL}, {RATES.format(source='bx')} select id, \"timestamp\", service, rate from rates")
def _(spark, sf):
    return error_rate(fx.burst(spark, sf)).select("id", "timestamp", "service", "rate")


@query("error_rate_60s_by_service", f"""with {ENTRIES_SQL}, e as (select *, epoch_us("timestamp") as us from fx where level_rank >= 4)
  select id, service, count(*) over (partition by service order by us range between 60000000 preceding and current row)
    - (count(*) over (partition by service, us) - row_number() over (partition by service, us order by seq, id)) as rate from e""")
def _(spark, sf):
    return error_rate(fx.entries(spark, sf), key="service").select("id", "service", "rate")


TICKS = """numbered as (select *, row_number() over (order by us, seq) as rn from rates),
  walk as (
    select rn, us, rate, service, us as last, rate::double as base, true as tick from numbered where rn = 1
    union all
    select n.rn, n.us, n.rate, n.service, case when n.us - w.last >= 1000000 then n.us else w.last end,
      case when n.us - w.last >= 1000000 then 0.3 * n.rate + 0.7 * w.base else w.base end, n.us - w.last >= 1000000
    from walk w join numbered n on n.rn = w.rn + 1)"""


@query("detect_spikes", f"""with recursive {BURST_SQL}, {RATES.format(source='bx')}, {TICKS}
  select make_timestamp(us) as detected_at, rate::double as rate, round(base, 6) as baseline, round(rate / base, 6) as factor, service
  from walk where tick and base > 1 and rate >= 3 * base""")
def _(spark, sf):
    found = detect_spikes(fx.burst(spark, sf))
    return found.select("detected_at", "rate", F.round("baseline", 6).alias("baseline"), F.round("factor", 6).alias("factor"), "service")


@query("sample_ticks", f"""with recursive {BURST_SQL}, {RATES.format(source='bx')}, {TICKS}
  select make_timestamp(us) as sampled_at, rate::double as rate, service from walk where tick""")
def _(spark, sf):
    return sample_ticks(fx.burst(spark, sf)).select(
        F.timestamp_micros("us").cast("timestamp_ntz").alias("sampled_at"), "rate", "service")


def correlation_sql(base: str, table: str, where: str, window: int) -> str:
    return f"""with {base}, e as (select service, epoch("timestamp")::bigint - case when epoch("timestamp") < epoch("timestamp")::bigint then 1 else 0 end as sec from {table} where {where}),
  counts as (select service, count(*) as n from e group by service), secs as (select service, sec, count(*) as n from e group by all),
  co as (select a.service as service_a, b.service as service_b, sum(a.n) as co from secs a, counts b
    where a.service < b.service and exists (select 1 from secs x where x.service = b.service and x.sec between a.sec - {window} and a.sec + {window}) group by all)
  select service_a, service_b, round(co / least(a.n, b.n), 5) as correlation_score from co join counts a on a.service = service_a join counts b on b.service = service_b
  where co / least(a.n, b.n) > 0.3"""


@query("service_correlation", correlation_sql(ENTRIES_SQL, "fx", "level_rank >= 4", 1800))
def _(spark, sf):
    found = service_correlation(fx.entries(spark, sf), 1800, errors_only=True)
    return found.select("service_a", "service_b", F.round(F.col("correlation_score").cast("double"), 5).alias("correlation_score"))


@query("service_correlation_users", correlation_sql(
    f"{ENTRIES_SQL}, ux as (select * replace (concat('u', cast(user_id % 40 as varchar)) as service) from fx)", "ux", "true", 1800))
def _(spark, sf):
    users = fx.entries(spark, sf).withColumn("service", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")))
    found = service_correlation(users, 1800)
    return found.select("service_a", "service_b", F.round(F.col("correlation_score").cast("double"), 5).alias("correlation_score"))


# ---------------------------------------------------------------- lines

# The same shapes of lines as in the functions, in the dialect of the SQL side.
CONTINUED = r"""regexp_matches(value, '^\s\s|^\tat\s|^at\s+\S+\s*\(|^\s*File\s+"|^\s*Caused\s+by:|^\s*\d+:\s+0x[0-9a-f]+\s+-\s+|^\s+\d+\)\s+0x|^\s+\.\.\.\s+\d+\s+more|^note:|^caused\s+by:')"""


@query("is_continuation", f"with {LINES_SQL} select source_id, line_no, {CONTINUED} as continuation from lx")
def _(spark, sf):
    return fx.lines(spark, sf).select("source_id", "line_no", formats.is_continuation(F.col("value")).alias("continuation"))


MERGED_SQL = f"""{LINES_SQL}, marked as (select *, greatest(1, sum(case when {CONTINUED} then 0 else 1 end) over (partition by source_id, file order by line_no)) as grp from lx),
  merged as (select source_id, file, min(line_no) as line_no, min_by(value, line_no) as value, min_by(ingested_at, line_no) as ingested_at, min_by(seq, line_no) as seq,
    string_agg(value, '|' order by line_no) filter ({CONTINUED}) as stacktrace from marked group by source_id, file, grp)"""


@query("merge_stacktraces", f"with {MERGED_SQL} select source_id, line_no, value, stacktrace from merged")
def _(spark, sf):
    return merge_stacktraces(fx.lines(spark, sf)).select("source_id", "line_no", "value", joined("stacktrace"))


DETECT = r"""case when starts_with(t, '{') and ends_with(t, '}') then 'json' when regexp_matches(t, '^\S+ - \S+ \[.+\] ".+" \d{3} \d+') then 'nginx'
  when regexp_matches(t, '^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ \S+') then 'syslog' when starts_with(t, '{"log":') then 'docker'
  when regexp_matches(t, '[\w\p{L}\p{N}]+=("[^"]*"|\S+)') then 'key_value' else 'plaintext' end"""


@query("detect_format", f"""with {LINES_SQL} select source_id, line_no, {DETECT} as format from (select *, trim(value) as t from lx)""")
def _(spark, sf):
    return fx.lines(spark, sf).select("source_id", "line_no", formats.detect_format(F.col("value")).alias("format"))


@query("detect_format_documents", f"""with {DOCUMENTS_SQL} select id, {DETECT} as format from (select *, trim(message) as t from dx)""")
def _(spark, sf):
    return fx.document_entries(spark, sf).select("id", formats.detect_format(F.col("message")).alias("format"))


PARSED = ["timestamp", "level", "service", "message", "format"]


def flat(df: DataFrame, *keys: str) -> DataFrame:
    return only_parsed(df).select(*keys, *[F.col(f"parsed.{c}").alias(c) for c in PARSED])


JSON_LINES_SQL = f"""{LINES_SQL}, jx as (select *, case when json_valid(value) then value::json end as j from lx where json_valid(value))"""


@query("parse_json", f"""with {JSON_LINES_SQL} select source_id, line_no, coalesce(j->>'timestamp', j->>'time')::timestamp as "timestamp", coalesce(j->>'level', 'unknown') as level,
  j->>'service' as service, coalesce(j->>'log', j->>'message') as message, case when j->>'log' is null then 'json' else 'docker' end as format from jx""")
def _(spark, sf):
    return flat(parse_json(fx.lines(spark, sf)), "source_id", "line_no")


@query("parse_json_props", """select event_id, null::timestamp as "timestamp", 'unknown' as level, null::varchar as service, '' as message, 'json' as format,
  concat('{"k":', props->>'k', '}') as fields from events where json_valid(props)""")
def _(spark, sf):
    df = only_parsed(parse_json(fx.table(spark, sf, "events"), "props"))
    return df.select("event_id", *[F.col(f"parsed.{c}").alias(c) for c in (*PARSED, "fields")])


@query("parse_kv", f"""with {LINES_SQL} select source_id, line_no, nullif(regexp_extract(value, '\\btime=(\\S+)', 1), '')::timestamp as "timestamp",
  coalesce(nullif(regexp_extract(value, '\\blevel=(\\S+)', 1), ''), 'unknown') as level, nullif(regexp_extract(value, '\\bservice=(\\S+)', 1), '') as service,
  case when regexp_matches(value, '\\bmsg="') then regexp_extract(value, '\\bmsg="([^"]*)"', 1) else value end as message, 'key_value' as format from lx where trim(value) <> ''""")
def _(spark, sf):
    return flat(parse_kv(fx.lines(spark, sf)), "source_id", "line_no")


@query("parse_container_envelope", f"""with {JSON_LINES_SQL} select source_id, line_no, (j->>'time')::timestamp as "timestamp", 'unknown' as level, null::varchar as service,
  j->>'log' as message, 'docker' as format from jx where j->>'log' is not null""")
def _(spark, sf):
    return flat(parse_container_envelope(fx.lines(spark, sf)), "source_id", "line_no")


TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?\s*"
LEVEL_WORD = r"(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|CRIT)\b"
PLAIN_SQL = rf"""(select *, regexp_extract(value, '{TIME}', 0) as head, regexp_replace(value, '{TIME}', '') as rest from @source)"""
PLAIN_LEVEL = rf"""case lower(regexp_extract(rest, '{LEVEL_WORD}', 1)) when 'trace' then 'trace' when 'debug' then 'debug' when 'info' then 'info' when 'warn' then 'warn' when 'warning' then 'warn'
  when 'error' then 'error' when 'err' then 'error' when 'fatal' then 'fatal' when 'critical' then 'fatal' when 'crit' then 'fatal' else 'unknown' end"""
PLAIN_SERVICE = r"""nullif(regexp_extract(rest, '\[([A-Za-z][\w\-.]{1,40})\]', 1), '')"""
PLAIN_MESSAGE = rf"""regexp_replace(regexp_replace(rest, '{LEVEL_WORD}', ''), '^[^\p{{L}}\p{{N}}/.]+|[^\p{{L}}\p{{N}}/.]+$', '', 'g')"""


@query("parse_plaintext", f"""with {LINES_SQL} select source_id, line_no, nullif(trim(head), '')::timestamp as "timestamp", {PLAIN_LEVEL} as level, {PLAIN_SERVICE} as service,
  case when {PLAIN_MESSAGE} = '' then trim(rest) else {PLAIN_MESSAGE} end as message, 'plaintext' as format from {PLAIN_SQL.replace('@source', 'lx')} where trim(value) <> ''""")
def _(spark, sf):
    return flat(parse_plaintext(fx.lines(spark, sf)), "source_id", "line_no")


@query("parse_plaintext_documents", f"""with {DOCUMENTS_SQL} select id, {PLAIN_LEVEL} as level, {PLAIN_SERVICE} as service,
  case when {PLAIN_MESSAGE} = '' then trim(rest) else {PLAIN_MESSAGE} end as message from {PLAIN_SQL.replace('@source', '(select id, message as value from dx) d')} where trim(value) <> ''""")
def _(spark, sf):
    return flat(parse_plaintext(fx.document_entries(spark, sf), "message"), "id").select("id", "level", "service", "message")


DEPOT_SQL = r"'^(\S+) <(\w+)> ([\w-]+) => (.*)$'"


@query("parse_custom", f"""with {LINES_SQL} select source_id, line_no, regexp_extract(value, {DEPOT_SQL}, 1)::timestamp as "timestamp", lower(regexp_extract(value, {DEPOT_SQL}, 2)) as level,
  regexp_extract(value, {DEPOT_SQL}, 3) as service, regexp_extract(value, {DEPOT_SQL}, 4) as message, 'unknown' as format from lx where regexp_matches(value, {DEPOT_SQL})""")
def _(spark, sf):
    return flat(parse_custom(fx.lines(spark, sf), compile_templates(TEMPLATES)["depot"]), "source_id", "line_no")


@query("parse_timestamps", f"""with {ENTRIES_SQL}, spelled as (select id, "timestamp", case seq % 4 when 0 then iso when 1 then replace(iso, 'Z', '+02:30') when 2 then replace(iso, 'Z', '') else substr(iso, 1, 10) end as txt, seq from fx)
  select id, txt, case seq % 4 when 0 then "timestamp" when 1 then "timestamp" - interval 150 minute end as parsed from spelled""")
def _(spark, sf):
    spelled = fx.entries(spark, sf).selectExpr("id", """case seq % 4 when 0 then iso when 1 then replace(iso, 'Z', '+02:30') when 2 then replace(iso, 'Z', '')
        else substring(iso, 1, 10) end as txt""")
    return spelled.withColumn("parsed", rfc3339(F.col("txt")))


def normalized(spark, sf) -> DataFrame:
    return normalize_lines(merge_stacktraces(fx.lines(spark, sf)), fx.sources(spark, sf), TEMPLATES)


@query("normalize_lines", f"""with {MERGED_SQL}, p as (select *, regexp_matches(value, {DEPOT_SQL}) and source_id <> 'src-2' as depot from {PLAIN_SQL.replace('@source', 'merged')}),
  n as (select source_id, line_no as seq,
    case when seq % 6 = 0 then (value->>'timestamp')::timestamp when seq % 6 = 1 then regexp_extract(value, 'time=(\\S+)', 1)::timestamp
      when seq % 6 = 4 then (value->>'time')::timestamp when depot then regexp_extract(value, {DEPOT_SQL}, 1)::timestamp else trim(head)::timestamp end as "timestamp",
    case when seq % 6 = 0 then value->>'level' when seq % 6 = 1 then regexp_extract(value, 'level=(\\S+)', 1) when seq % 6 = 4 then 'unknown' else {PLAIN_LEVEL} end as level,
    case when seq % 6 = 0 then value->>'service' when seq % 6 = 1 then regexp_extract(value, 'service=(\\S+)', 1) when seq % 6 = 4 then null
      when depot then regexp_extract(value, {DEPOT_SQL}, 3) else {PLAIN_SERVICE} end as service,
    case when seq % 6 = 0 then value->>'message' when seq % 6 = 1 then regexp_extract(value, 'msg="([^"]*)"', 1) when seq % 6 = 4 then value->>'log'
      when depot then regexp_extract(value, {DEPOT_SQL}, 4) else {PLAIN_MESSAGE} end as message,
    stacktrace, value as raw, case when seq % 6 = 0 then 'json' when seq % 6 = 1 then 'key_value' when seq % 6 = 4 then 'docker' when depot then 'unknown' else 'plaintext' end as format
  from p)
  select source_id, seq, "timestamp", level, service, message, stacktrace, raw, format, {fingerprint_sql(template_sql("message"))} as fingerprint from n""".replace("(value->>", "(case when starts_with(value, '{') then value end->>").replace("then value->>", "then case when starts_with(value, '{') then value end->>"))
def _(spark, sf):
    return normalized(spark, sf).select("source_id", "seq", "timestamp", "level", "service", "message", joined("stacktrace"), "raw", "format", "fingerprint")


class BlockParser(ParserPlugin):
    """Lines of any kind with the indented lines and causes below them as one entry."""

    id = "blocks"
    begins = r"^(?!\t|Caused by:)"

    def __init__(self):
        self.lines, self.line_no = [], None

    @classmethod
    def can_handle(cls, source):
        return source["label"] == "App src-1"

    def push_line(self, line, line_no):
        done = None if line.startswith(("\t", "Caused by:")) else self.flush()
        if not self.lines:
            self.line_no = line_no
        self.lines.append(line)
        return done

    def flush(self):
        if not self.lines:
            return None
        head, *trace = self.lines
        found = re.match(r"(\S+) ([A-Z]+) \[", head)
        time, level = found.groups() if found else (None, None)
        entry = {"line_no": self.line_no, "timestamp": time, "level": level, "message": head, "raw": "\n".join(self.lines), "stacktrace": trace}
        self.lines = []
        return entry


@query("parser_plugin", f"""with {MERGED_SQL}, blocks as (
  select *, regexp_extract(value, '^(\\S+) ([A-Z]+) \\[', 2) as word, regexp_extract(value, '^(\\S+) ([A-Z]+) \\[', 1) as iso from merged where source_id = 'src-1')
  select source_id, line_no as seq, coalesce(try_strptime(iso, '%Y-%m-%dT%H:%M:%S.%fZ'), ingested_at) as "timestamp",
    case when word = '' then 'unknown' else lower(word) end as level, value as message, stacktrace,
    concat_ws(chr(10), value, replace(stacktrace, '|', chr(10))) as raw from blocks""")
def _(spark, sf):
    found = normalize_with_plugins(fx.lines(spark, sf), fx.sources(spark, sf), PluginRegistry(BlockParser), TEMPLATES, chunk_lines=2000)
    return found.where("detected_format = 'plugin'").select("source_id", "seq", "timestamp", "level", "message", joined("stacktrace"), "raw")


def from_file(column: str = "file") -> Column:
    return F.regexp_extract(column, r"([^/]+)\.log$", 1)


@query("read_log_files", f"with {FILES_SQL} select name, name || '.log' as source_label, line_no, value from fl")
def _(spark, sf):
    folder = fx.write_log_folder(spark, sf)
    lines = R.read_log_files(spark, [f"{folder}/src-{i}.log" for i in range(3)])
    return lines.select(from_file("source_id").alias("name"), "source_label", "line_no", "value")


@query("read_log_dir", f"with {FILES_SQL} select 'app/' || name as name, 'App (' || name || '.log)' as source_label, line_no, value from fl where name <> 'src-1'")
def _(spark, sf):
    lines = R.read_log_dir(spark, fx.write_log_folder(spark, sf), "app", "App", pattern="src-[02].log")
    return lines.select(F.regexp_replace("source_id", r"/.*/(.+)\.log$", "/$1").alias("name"), "source_label", "line_no", "value")


@query("read_container_logs", f"""with {FILES_SQL} select 'box' as source_id, line_no, rtrim(value) as value from fl
  where name = 'src-2' and rtrim(value) <> '' order by line_no desc limit 50""")
def _(spark, sf):
    return R.read_container_logs(spark, f"{fx.write_log_folder(spark, sf)}/src-2.log", "box", tail=50).select("source_id", "line_no", "value")


@query("read_container_service", f"""with {FILES_SQL} select 'svc' as source_id, 'Service' as source_label, name, line_no, rtrim(value) as value from fl
  where name in ('src-0', 'src-1') and rtrim(value) <> ''""")
def _(spark, sf):
    folder = fx.write_log_folder(spark, sf)
    containers = fx.sources(spark, sf).select(
        F.when(F.col("source_id") == "src-2", "other").otherwise("web").alias("service_name"), F.concat(F.lit(folder + "/"), "source_id", F.lit(".log")).alias("path"))
    return R.read_container_service(spark, containers, "web", "svc", "Service").select("source_id", "source_label", from_file().alias("name"), "line_no", "value")


@query("read_system_export", f"with {FILES_SQL} select 'journal' as source_id, line_no, value from fl where name = 'src-1' and trim(value) <> ''")
def _(spark, sf):
    return R.read_system_export(spark, f"{fx.write_log_folder(spark, sf)}/src-1.log", "journal", "Journal").select("source_id", "line_no", "value")


@query("read_sources", f"""with {FILES_SQL}
  select 'one' as source_id, 'One' as source_label, line_no, value from fl where name = 'src-0'
  union all select 'box', 'Box', line_no, rtrim(value) from fl where name = 'src-1' and rtrim(value) <> ''
  union all select 'journal', 'Journal', line_no, value from fl where name = 'src-2' and trim(value) <> ''""")
def _(spark, sf):
    folder = fx.write_log_folder(spark, sf)
    rows = [("one", "One", ("file", f"{folder}/src-0.log", None, None), True), ("box", "Box", ("docker_container", f"{folder}/src-1.log", None, None), True),
            ("journal", "Journal", ("journald", f"{folder}/src-2.log", None, None), True), ("off", "Off", ("file", f"{folder}/none.log", None, None), False)]
    table = spark.createDataFrame(rows, "source_id string, label string, kind struct<type:string,path:string,pattern:string,name:string>, enabled boolean")
    return R.read_sources(spark, table).select("source_id", "source_label", "line_no", "value")


@query("stream_log_files", f"with {FILES_SQL} select name, line_no, value from fl where trim(value) <> ''")
def _(spark, sf):
    stream = stream_log_files(spark, fx.write_log_folder(spark, sf), blank_policy="blank", max_files=1)
    return collected(stream, "rolled").select(from_file().alias("name"), "line_no", "value")


@query("parse_custom_time", f"""with {ENTRIES_SQL} select seq, date_trunc('second', "timestamp") as "timestamp", message from fx""")
def _(spark, sf):
    template = LineTemplate("slashed", "Slashed", r"^(?P<timestamp>\S+ \S+) (?P<message>.*)$", "%Y/%m/%d %H:%M:%S")
    lines = fx.entries(spark, sf).select("seq", F.concat_ws(" ", F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss"), "message").alias("value"))
    found = parse_custom(lines, compile_templates([template])["slashed"])
    return found.select("seq", "parsed.timestamp", "parsed.message")


@query("load_sources", f"with {ENTRIES_SQL} select distinct source_id, concat('App ', source_id) as label from fx where source_id <> 'src-1'")
def _(spark, sf):
    return load_sources(fx.sources(spark, sf)).select("source_id", "label")


@query("container_tail_50", f"with {LINES_SQL} select source_id, line_no, value from lx qualify row_number() over (partition by source_id order by line_no desc) <= 50")
def _(spark, sf):
    return tail_lines(fx.lines(spark, sf)).select("source_id", "line_no", "value")


# ---------------------------------------------------------------- stored tables and exports

@query("append_dedup", f"""with {ENTRIES_SQL} select {ENTRY_SQL} from fx where seq % 3 <> 0""")
def _(spark, sf):
    e = fx.entries(spark, sf)
    return S.new_entries(e.unionByName(e.where("seq % 2 = 0")), e.where("seq % 3 = 0")).select(*ENTRY)


@query("purge_before", f"""with {ENTRIES_SQL} select case when "timestamp" >= timestamp '{FROM}' then 'kept' else 'removed' end as what, count(*) as entries from fx group by all""")
def _(spark, sf):
    kept, removed = S.split_by_age(fx.entries(spark, sf), FROM)
    return S.count_entries(kept).withColumn("what", F.lit("kept")).unionByName(S.count_entries(removed).withColumn("what", F.lit("removed")))


@query("purge_stored", f"""with {ENTRIES_SQL} select {ENTRY_SQL}, (select count(*) from fx where "timestamp" < timestamp '{FROM}') as removed
  from fx where "timestamp" >= timestamp '{FROM}'""")
def _(spark, sf):
    path = shared_dir(spark, "entries")
    S.append_entries(fx.entries(spark, sf), path)
    removed = S.purge_before(spark, path, FROM)
    return S.read_table(spark, path).select(*ENTRY, F.lit(removed).cast("long").alias("removed"))


@query("count_entries", "select count(*) as entries from events")
def _(spark, sf):
    return S.count_entries(fx.entries(spark, sf))


@query("export_markdown_rows", f"""with {ENTRIES_SQL} select concat('| ', strftime("timestamp", '%Y-%m-%d %H:%M:%S'), ' | ', upper(substr(level, 1, 1)), substr(level, 2), ' | ',
  service, ' | ', replace(substr(message, 1, 120), '|', '\\|'), ' |') as line from fx order by "timestamp" desc, id limit 500""")
def _(spark, sf):
    return EX.export_markdown_rows(fx.entries(spark, sf)).select("line")


@query("export_json_rows", f"""with {ENTRIES_SQL}, newest as (select * from fx where level = 'error' order by "timestamp" desc, id limit 5000)
  select id, concat('{{"id":"', id, '","timestamp":"', iso, '","level":"', level, '","service":"', service, '","message":"', message, '"}}') as json from newest""")
def _(spark, sf):
    chosen = EX.export_selection(fx.entries(spark, sf), ("error",)).select("id", "timestamp", "level", "service", "message")
    return EX.export_json_rows(chosen)


@query("export_all_json", f"""with {ENTRIES_SQL}, rows as (select "timestamp" as t, id, concat('{{"id":"', id, '","timestamp":"', iso, '","level":"', level,
    '","service":"', service, '","message":"', message, '"}}') as line, row_number() over (order by "timestamp" desc, id) as n from fx),
  whole as (select 0 as line_no, concat('{{"exported_at":"2024-02-01T00:00:00Z","entry_count":', count(*), ',"ai_summary":null,"entries":[') as line from rows
    union all select n, case when n > 1 then ',' else '' end || line from rows union all select count(*) + 1, ']}}' from rows)
  select cast(line_no as bigint) as line_no, line from whole""")
def _(spark, sf):
    path = shared_dir(spark, "export") + ".json"
    EX.export_all(fx.entries(spark, sf).select("id", "timestamp", "level", "service", "message"), path, "2024-02-01T00:00:00Z")
    return EX.read_lines(spark, path)


@query("export_all_markdown", f"""with {ENTRIES_SQL}, rows as (select concat('| ', strftime("timestamp", '%Y-%m-%d %H:%M:%S'), ' | ', upper(substr(level, 1, 1)), substr(level, 2), ' | ',
    service, ' | ', replace(substr(message, 1, 120), '|', '\\|'), ' |') as line, row_number() over (order by "timestamp" desc, id) as n from fx where level = 'error'),
  heads as (select unnest(['# Log Export', '', '**Exported:** 2024-02-01T00:00:00Z  ', '**Entries:** ' || (select count(*) from rows), '', '## Log Entries', '',
    '| Timestamp | Level | Service | Message |', '|-----------|-------|---------|--------|']) as line, unnest(range(9)) as n)
  select n as line_no, line from heads union all select n + 8, line from rows""")
def _(spark, sf):
    path = shared_dir(spark, "export") + ".md"
    EX.export_all(fx.entries(spark, sf), path, "2024-02-01T00:00:00Z", levels=("error",))
    return EX.read_lines(spark, path)


@query("export_documents", f"""with {ENTRIES_SQL} select 'markdown' as kind, least(count(*), 5000) as entries from fx union all select 'json', least(count(*), 5000) from fx""")
def _(spark, sf):
    chosen = EX.export_selection(fx.entries(spark, sf)).select("id", "timestamp", "level", "service", "message")
    as_json = EX.export_json(chosen, "2024-02-01T00:00:00Z").select(
        F.lit("json").alias("kind"), F.get_json_object("document", "$.entry_count").cast("long").alias("entries"))
    as_text = EX.export_markdown(chosen, "2024-02-01T00:00:00Z").select(
        F.lit("markdown").alias("kind"), F.regexp_extract("document", r"\*\*Entries:\*\* (\d+)", 1).cast("long").alias("entries"))
    return as_text.unionByName(as_json)


# ---------------------------------------------------------------- prompts and answers

UTC = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"
LABEL = "concat(upper(substr(level, 1, 1)), substr(level, 2))"


@query("explain_prompts", f"""with {ENTRIES_SQL} select id as entry_id, concat_ws(chr(10), 'Explain this log entry to the engineer on duty.', concat('Time: ', iso), concat('Level: ', {LABEL}),
  concat('Service: ', service), concat('Message: ', message), case when stacktrace is not null then concat('Stack trace:', chr(10), list_aggregate(stacktrace, 'string_agg', chr(10))) end,
  concat('Raw line: ', substr(raw, 1, 500)), '{X._ANSWER}{X._EXPLAIN_KEYS}') as prompt from fx where level_rank >= 4""")
def _(spark, sf):
    return X.explain_prompts(Q.errors_to_explain(fx.entries(spark, sf)))


@query("ask_model", f"select entry_id, concat(length(prompt), ':', upper(substr(prompt, 1, 30))) as reply from ({SQL['explain_prompts']})")
def _(spark, sf):
    prompts = X.explain_prompts(Q.errors_to_explain(fx.entries(spark, sf)))
    return X.ask_model(prompts, lambda texts: [f"{len(t)}:{t[:30].upper()}" for t in texts]).select("entry_id", "reply")


@query("summary_prompts", f"""with {ENTRIES_SQL}, blocked as (select *, source_id as block from fx), levels as (select block, level, count(*) as n from blocked group by all),
  newest as (select *, row_number() over (partition by block order by "timestamp" desc, id) as rank from blocked qualify rank <= 20)
  select block, concat_ws(chr(10), 'Summarise this block of log entries for the team that runs the system.',
    concat('Time range: ', {UTC.format('min("timestamp")')}, ' to ', {UTC.format('max("timestamp")')}), concat('Entries: ', count(*)),
    concat('Levels: ', (select string_agg(concat({LABEL}, '=', cast(n as varchar)), ', ' order by level) from levels l where l.block = b.block)),
    concat('Sample, newest first, at most 20:', chr(10), (select string_agg(concat('[', {LABEL}, '] ', service, ' ', message), chr(10) order by rank) from newest n where n.block = b.block)),
    '{X._ANSWER}{X._SUMMARY_KEYS}') as prompt from blocked b group by block""")
def _(spark, sf):
    return X.summary_prompts(X.block_summary(fx.entries(spark, sf), F.col("source_id")))


@query("root_cause_prompts", f"""with {SUMMARY_SQL}, newest as (select cluster_id, message, row_number() over (partition by cluster_id order by "timestamp" desc, id) as rank from clustered qualify rank <= 5)
  select cluster_id, concat_ws(chr(10), 'Find the root cause of this group of similar log entries.', concat('Template: ', template), concat('Occurrences: ', count), concat('Level: ', {LABEL}),
    concat('Services: ', replace(services, '|', ', ')), concat('First seen: ', {UTC.format('first_seen')}), concat('Last seen: ', {UTC.format('last_seen')}),
    concat('Sample messages:', chr(10), (select string_agg(concat('- ', message), chr(10) order by rank) from newest w where w.cluster_id = n.cluster_id)),
    '{X._ANSWER}{X._ROOT_CAUSE_KEYS}') as prompt from named n""")
def _(spark, sf):
    e = clustered(spark, sf)
    return X.root_cause_prompts(C.cluster_summary(e), e)


def texts_sql(name: str) -> str:
    return f"(select coalesce(string_agg(j->>'$', '|' order by i), '') from (select unnest(from_json(a->'{name}', '[\"json\"]')) as j, generate_subscripts(from_json(a->'{name}', '[\"json\"]'), 1) as i) where json_type(j) = 'VARCHAR')"


def text_sql(name: str, default: str = "") -> str:
    return f"case when json_type(a->'{name}') = 'VARCHAR' then a->>'{name}' else '{default}' end"


CONFIDENCE = "coalesce((a->>'confidence')::double, 0.5)"


@query("parse_explanations", f"""with {REPLIES_SQL} select entry_id, {text_sql('what')} as what, {text_sql('why')} as why, {text_sql('impact')} as impact,
  {texts_sql('debug_steps')} as debug_steps, {texts_sql('possible_causes')} as possible_causes, {CONFIDENCE} as confidence from ok""")
def _(spark, sf):
    parsed = X.parse_explanations(fx.replies(spark, sf))
    return parsed.select("entry_id", "what", "why", "impact", joined("debug_steps"), joined("possible_causes"), F.col("confidence").cast("double").alias("confidence"))


@query("parse_summaries", f"""with {REPLIES_SQL} select entry_id, {text_sql('overview')} as overview, {texts_sql('key_issues')} as key_issues from ok""")
def _(spark, sf):
    return X.parse_summaries(fx.replies(spark, sf), ("entry_id",)).select("entry_id", "overview", joined("key_issues"))


@query("parse_root_causes", f"""with {REPLIES_SQL}, steps as (select entry_id, unnest(from_json(a->'fix_suggestions', '["json"]')) as j, generate_subscripts(from_json(a->'fix_suggestions', '["json"]'), 1) as i from ok)
  select entry_id, {text_sql('title', 'Root Cause Analysis')} as title, {text_sql('root_cause')} as root_cause, {texts_sql('evidence')} as evidence,
  (select coalesce(string_agg(concat(coalesce((j->>'step')::int, i), '/', coalesce(j->>'title', ''), '/', coalesce(j->>'description', ''), '/', coalesce(j->>'command', '-'), '/', coalesce(j->>'code', '-')), '|' order by i), '')
    from steps s where s.entry_id = ok.entry_id) as fix_suggestions, {CONFIDENCE} as confidence from ok""")
def _(spark, sf):
    parsed = X.parse_root_causes(fx.replies(spark, sf), ("entry_id",))
    step = lambda s: F.concat_ws("/", s["step"].cast("string"), s["title"], s["description"], F.coalesce(s["command"], F.lit("-")), F.coalesce(s["code"], F.lit("-")))
    return parsed.select("entry_id", "title", "root_cause", joined("evidence"), F.array_join(F.transform("fix_suggestions", step), "|").alias("fix_suggestions"),
                         F.col("confidence").cast("double").alias("confidence"))


# ---------------------------------------------------------------- streams

def event_stream(spark, sf) -> DataFrame:
    """The events table as a stream of entries."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return fx.as_entries(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def run_stream(stream: DataFrame, each, output_mode: str = "append") -> None:
    """Process all available input, then stop."""
    checkpoint = shared_dir(stream.sparkSession, "stream-checkpoint")
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(each).start().awaitTermination()


def collected(stream: DataFrame, purpose: str, output_mode: str = "append") -> DataFrame:
    """All rows a stream puts out."""
    spark, out = stream.sparkSession, shared_dir(stream.sparkSession, purpose)
    run_stream(stream, lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"), output_mode)
    return spark.read.parquet(out).drop("batch")


@query("stream_timeline", f"with {ENTRIES_SQL} select {BUCKET} as bucket, level, count(*) as count from fx group by all")
def _(spark, sf):
    return collected(ST.timeline_stream(event_stream(spark, sf)), "timeline", "complete")


@query("stream_timeline_append", f"""with {ENTRIES_SQL}, counted as (select {BUCKET} as bucket, level, count(*) as count from fx group by all)
  select * from counted where bucket + interval 5 minute <= (select max("timestamp") from fx) - interval 10 minute""")
def _(spark, sf):
    # A bucket comes out once the watermark has passed its end.
    return collected(ST.timeline_stream(event_stream(spark, sf)), "timeline")


@query("stream_merge_stacktraces", f"""with {MERGED_SQL} select source_id, line_no, value, stacktrace from merged""")
def _(spark, sf):
    merged = collected(ST.merge_stacktraces_stream(fx.as_lines(event_stream(spark, sf)), flush_after_ms=None, whole_files=True), "lines")
    return merged.select("source_id", "line_no", "value", joined("stacktrace"))


@query("stream_spikes", SQL["detect_spikes"])
def _(spark, sf):
    moved = fx.as_burst(event_stream(spark, sf))
    found = collected(ST.detect_spikes_stream(moved), "spikes")
    return found.select("detected_at", "rate", F.round("baseline", 6).alias("baseline"), F.round("factor", 6).alias("factor"), "service")


@query("stream_upsert_clusters", f"with {SUMMARY_SQL} select {', '.join(SUMMARY)} from named")
def _(spark, sf):
    store = shared_dir(spark, "store")
    run_stream(C.cluster_exact(event_stream(spark, sf)), lambda batch, batch_id: store_batch(batch, batch_id, store))
    return flat_summary(S.read_snapshot(spark, f"{store}/clusters"))


@query("stream_append_dedup", f"with {ENTRIES_SQL} select {ENTRY_SQL} from fx")
def _(spark, sf):
    path = shared_dir(spark, "entries")
    for _ in range(2):  # the second stream brings nothing new
        run_stream(event_stream(spark, sf), lambda batch, batch_id: S.append_entries(batch, path))
    return S.read_table(spark, path).select(*ENTRY)


@query("stream_ingest", SQL["normalize_lines"])
def _(spark, sf):
    store = shared_dir(spark, "store")
    lines = fx.as_lines(event_stream(spark, sf)).withColumn("source_label", F.col("source_id"))
    ingest(lines, store, shared_dir(spark, "stream-checkpoint"), fx.sources(spark, sf), TEMPLATES,
           trigger={"availableNow": True}).awaitTermination()
    close_pending(spark, store, fx.sources(spark, sf), TEMPLATES)
    stored = S.read_table(spark, f"{store}/entries")
    return stored.select("source_id", "seq", "timestamp", "level", "service", "message", joined("stacktrace"), "raw", "format", "fingerprint")


@query("stream_top_clusters", f"""select fingerprint as cluster_id, count(*) as count from ({SQL['normalize_lines']}) group by fingerprint
  having max(case level when 'error' then 4 when 'fatal' then 5 when 'unknown' then 6 else 0 end) >= 4 order by count desc, cluster_id limit 5""")
def _(spark, sf):
    store, out = shared_dir(spark, "store"), shared_dir(spark, "top")
    lines = fx.as_lines(event_stream(spark, sf)).withColumn("source_label", F.col("source_id"))
    ingest(lines, store, shared_dir(spark, "stream-checkpoint"), fx.sources(spark, sf), TEMPLATES, whole_files=True, trigger={"availableNow": True},
           on_batch=lambda top, batch_id: top.write.mode("overwrite").parquet(out)).awaitTermination()
    return spark.read.parquet(out).select("cluster_id", "count")


@query("stream_live_entries", SQL["normalize_lines"])
def _(spark, sf):
    store = shared_dir(spark, "store")
    lines = fx.as_lines(event_stream(spark, sf)).withColumn("source_label", F.col("source_id"))
    ingest(lines, store, shared_dir(spark, "stream-checkpoint"), fx.sources(spark, sf), TEMPLATES, feed=True,
           trigger={"availableNow": True}).awaitTermination()
    close_pending(spark, store, fx.sources(spark, sf), TEMPLATES, feed=True)
    fed = read_feed(spark, store)
    return fed.select("source_id", "seq", "timestamp", "level", "service", "message", joined("stacktrace"), "raw", "format", "fingerprint")


def followed(spark, sf, transform=lambda lines: lines) -> DataFrame:
    """What one stream over growing log files gives in three runs, between which the files grow."""
    lines = fx.lines(spark, sf)
    folder, out, checkpoint = (shared_dir(spark, name) for name in ("logs", "followed", "stream-checkpoint"))
    highest = lines.agg(F.max("line_no")).first()[0] or 0
    for until in (highest // 3, 2 * highest // 3, None):
        fx.write_logs(lines, folder, until)
        stream = transform(follow_log_files(spark, folder, start="beginning", split_bytes=200_000))
        (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")).start().awaitTermination())
    return spark.read.parquet(out).drop("batch").withColumn("source_id", F.regexp_extract("file", r"([^/]+)\.log#", 1)).withColumnRenamed("line_no", "position")


PLACED_SQL = f"""{LINES_SQL}, placed as (
  select * replace (cast(sum(strlen(value) + 1) over (partition by source_id order by line_no) - strlen(value) - 1 as bigint) as line_no) from lx)"""


@query("stream_follow_files", f"with {PLACED_SQL} select source_id, line_no as position, value from placed")
def _(spark, sf):
    return followed(spark, sf).select("source_id", "position", "value")


@query("stream_assemble_files", f"""with {PLACED_SQL},
  marked as (select *, greatest(1, sum(case when {CONTINUED} then 0 else 1 end) over (partition by source_id order by line_no)) as grp from placed),
  merged as (select source_id, grp, min(line_no) as position, min_by(value, line_no) as value,
    string_agg(value, '|' order by line_no) filter ({CONTINUED}) as stacktrace from marked group by source_id, grp)
  select source_id, position, value, stacktrace from merged qualify grp < max(grp) over (partition by source_id)""")
def _(spark, sf):
    # The last entry of each file is still open when the stream stops.
    merged = followed(spark, sf, lambda lines: assemble_stream(lines, flush_after_ms=None, chunk=1 << 16))
    return merged.select("source_id", "position", "value", joined("stacktrace"))
