"""Registered queries of the training-data operators and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm import (
    conversations, fuzzy_lines, languages, licenses, mixing, neardup, perplexity, secrets, spelling, suffix_tree, token_files, urls, winnow,
)
from tracewell.llm.texts import PLAIN_WORDS, UPPER, WORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOWER = UPPER.lower()


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as size from documents),
h as (select *, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || cast(size as varchar)), 1, 12) as bigint) as hash from d),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as w, source_size * 2.0::double as room from s),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(room) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
      from w window o as (order by room / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, level * w >= room as stopped, room / w as place from l),
t as (select source, source_size, case when stopped or (select count(*) from f where not stopped) = 0 then room
      else (select arg_min(level, place) from f where not stopped) * w end as target from f),
r as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as rounds from t),
b as (select source, hash, sum(size) as size, sum(sum(size)) over (partition by source order by hash) - sum(size) as before from h group by source, hash),
e as (select b.source, b.hash, before + size <= target - rounds * source_size
      or (before <= target - rounds * source_size
          and before + size - (target - rounds * source_size) < (target - rounds * source_size) - before) as extra
      from b join r on b.source is not distinct from r.source)
select doc_id, size, source_size, target, cast(size * (rounds + cast(extra as bigint)) as bigint) as taken
from h join r on h.source is not distinct from r.source
join e on h.source is not distinct from e.source and h.hash = e.hash
"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


NEAR_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
u as (select doc_id, unnest(s) as g from s),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as n from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join s a on a.doc_id = x join s b on b.doc_id = y where 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
e as (select x, y from links union all select y, x from links),
r(doc_id, c) using key (doc_id) as (
  select doc_id, doc_id from s
  union
  select e.y, min(r.c) from r join e on e.x = r.doc_id join recurring.r as q on q.doc_id = e.y where r.c < q.c group by e.y)
select s.doc_id, cast(len(s) as bigint) as n_shingles, c as component_id, s.doc_id = c as kept from s join r using (doc_id)
"""


@query("op6_near_duplicates", NEAR_SQL)
def op6_near_duplicates(spark, sf):
    found = neardup.near_duplicates(table(spark, sf, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


WINNOW_SQL = rf"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORDS}') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORDS}') as w from benchmark),
win as (select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
        from (select *, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from iw where len(w) > 0)),
ks as (select distinct k from win),
dp as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, ks where len(w) >= k)),
m as (select distinct doc_id, dp.k, i, item_id from dp join win on dp.g = win.g and dp.k = win.k),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items,
       array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from m group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join it using (doc_id)
"""


@query("op7_decontaminate", WINNOW_SQL)
def op7_decontaminate(spark, sf):
    return winnow.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_a", "text_b")


@query("op9_token_files")
def op9_token_files(spark, sf):
    import public_tokenizers

    return token_files.token_files(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_quality_rules")
def op2_quality_rules(spark, sf):
    found = perplexity.quality(table(spark, sf, "documents"))
    return found.select("doc_id", *perplexity.MEASURES, "base_failed", "kept", "log_perplexity", "least", "most")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


URL_SQL = rf"""
with u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '(?s)^[^?#]*(.*)$', 1) as tail from u),
s as (select row_number() over () as r, *, host || path || tail as subject from p),
rules(name, verdict, pattern, rank) as (values {", ".join(f"({_quoted(r.name)}, '{r.verdict}', {_quoted(r.pattern)}, {r.rank})" for r in urls.RULES)}),
m as (select r, arg_max(name, [rank, length(name)]) as name, arg_max(verdict, [rank, length(name)]) as verdict, max(rank) as rank
      from s join rules on regexp_matches(subject, pattern) group by r)
select page_id, host, path, case when rank > 0 then name end as rule, coalesce(verdict, 'allow') as verdict from s left join m using (r)
"""


@query("op4_url_filters", URL_SQL)
def op4_url_filters(spark, sf):
    return urls.judge_urls(table(spark, sf, "pages"))


@query("op5_suffix_tree")
def op5_suffix_tree(spark, sf):
    return suffix_tree.score_documents(table(spark, sf, "documents"))


@query("op10_license_scan")
def op10_license_scan(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"))


@query("op3_fuzzy_lines")
def op3_fuzzy_lines(spark, sf):
    return fuzzy_lines.fuzzy_lines(table(spark, sf, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf):
    return secrets.scan_secrets(table(spark, sf, "documents"))


@query("op11_languages")
def op11_languages(spark, sf):
    return languages.identify_languages(table(spark, sf, "documents"))


# The table of CRC-32 by its rule, and the checksum of an SQL string that reads it as ``t``.
CRC_TABLE = ("list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), "
             "lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))")


def crc_sql(text: str) -> str:
    octets = f"hex(encode({text}))"
    values = f"list_transform(range(cast(length({octets}) / 2 as bigint)), lambda i: cast('0x' || {octets}[2 * i + 1:2 * i + 2] as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295)"


REPAIR_SQL = rf"""
with recursive t as materialized (select {CRC_TABLE} as t),
x as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
d as (select *, {crc_sql('k')} % 20 as c from x, t),
e as (select conv_id, turn, case when c = 4 then 'user' else role end as role,
  case when c = 1 then '' when c = 2 then translate(text, '.!?', '') else text end as text, unnest(case when c = 3 then [0, 1] else [0] end) as copy
  from d where c <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
  right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as body from e),
f as (select *, case when body = '' then 'blank' when seen > 1 then 'duplicate' when body not in ('.', '!', '?') then 'truncated' else '' end as fault,
  role[1:1] as r, lag(role[1:1]) over (partition by conv_id order by i) as r0 from o),
-- States 1 to 4: nothing yet, after s, after u, after a; what comes next, and the state after 0, 1 and 2 inserts.
m as (select ['u', 'u', 'a', 'u'] as need, [3, 3, 4, 3] as after, [[1, 3, 4], [2, 3, 4], [3, 4, 3], [4, 3, 4]] as moved,
  [['user:', 'assistant:'], ['user:', 'assistant:'], ['assistant:', 'user:'], ['user:', 'assistant:']] as put),
v(conv_id, i, s) as (
  select distinct conv_id, 0::bigint, [{{'q': 1, 'cost': 0, 'audit': '', 'said': []::varchar[]}}] from conversations
  union all
  select v.conv_id, f.i, (
    select list({{'q': b.q, 'cost': b.cost, 'audit': b.audit, 'said': b.said}}) from (
      select z.q as q, unnest(list_sort(list(z))[1:1], recursive := true) from (
        select unnest(list_filter(flatten(list_transform(s, lambda p: flatten(list_transform([0, 1, 2], lambda n: list_transform(['D', 'K', 'R'], lambda a: {{
          'q': case when a = 'D' then moved[p.q][n + 1] when a = 'R' then after[moved[p.q][n + 1]]
            when r = need[moved[p.q][n + 1]] then after[moved[p.q][n + 1]] when r = 's' and moved[p.q][n + 1] = 1 then 2 else 0 end,
          'cost': p.cost + 3 * n + case a when 'D' then 4 when 'R' then 3 else 0 end + case when a <> 'D' and fault = 'truncated' then 3 else 0 end,
          'audit': p.audit || repeat('I', n) || a,
          'said': p.said || put[p.q][1:n] || case a when 'D' then [] when 'K' then [role || ':' || text]
            else [case need[moved[p.q][n + 1]] when 'u' then 'user:' else 'assistant:' end || text] end}}))))),
          lambda z: z.q > 0 and (z.audit like '%D' or fault not in ('blank', 'duplicate')))) as z) group by z.q) b)
  from v join f on f.conv_id is not distinct from v.conv_id and f.i = v.i + 1, m),
n as (select conv_id, max(i) as i from v group by conv_id),
w as (select v.conv_id, list_sort(list_transform(s, lambda p: {{
    'cost': p.cost + [0, 6, 3, 0][p.q], 'audit': p.audit || ['', 'II', 'I', ''][p.q], 'said': p.said || put[p.q][1:[0, 2, 1, 0][p.q]]}}))[1] as best
  from v join n on v.conv_id is not distinct from n.conv_id and v.i = n.i, m),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (r0 is not null and r0 || r not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select w.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(best.cost as bigint) as cost, best.audit as audit,
  sha256(array_to_string(best.said, chr(10))) as repaired_sha256
from w left join g on w.conv_id is not distinct from g.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark, sf):
    return conversations.repair_digests(conversations.damaged(table(spark, sf, "conversations")))


SPELL_SQL = rf"""
with recursive t as materialized (select {CRC_TABLE} as t),
d as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
s as (select run, count(*) as n, length(run) as l, coalesce(cast(doc_id as varchar), '') || ':' || run as k from d where length(run) >= 5 group by doc_id, run),
c as (select run, n, l, {crc_sql('k')} as h from s, t),
w as (select case when h % 97 = 0 then run[1:h % l] || run[h % l + 2:] else run end as word, sum(n) as n from c group by 1),
v as (select word, cast(n as bigint) as n, length(word) as l from w where length(word) >= 5 and n >= 3),
g as (select word, n, l, i, word[1:i - 1] || word[i + 1:] as cut from (select *, unnest(range(1, l + 1)) as i from v)),
near as (select distinct a.word, b.word as near, b.n as near_n from g a join g b on a.cut = b.cut and a.i = b.i and a.l = b.l and a.word <> b.word
  union select g.word, v.word, v.n from g join v on g.cut = v.word
  union select v.word, g.word, g.n from g join v on g.cut = v.word),
b as (select word, count(*) as n_near, min({{'down': -near_n, 'near': near}}) as best from near group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best.down >= 2 * v.n then best.near end as form,
  case when -best.down >= 2 * v.n then -best.down end as form_n from v left join b using (word)),
r(word, root) as (select word, form from f where form is not null union all select r.word, f.form from r join f on f.word = r.root where f.form is not null),
e as (select r.word, r.root from r join f on f.word = r.root where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from f left join e using (word)
"""


@query("op13_spelling_variants", SPELL_SQL)
def op13_spelling_variants(spark, sf):
    return spelling.spelling_variants(table(spark, sf, "documents"))
