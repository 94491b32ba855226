"""URL filters: pattern rules found through their rarest literal token.

Every rule names the literal tokens (runs of a-z and 0-9) that any match contains. Tokens
are counted over the distinct URLs, a rule is filed under its rarest one, and a URL runs
only the regular expressions that its own tokens fetch. A rule without literals is filed
under the empty token, which every URL has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.texts import lowered
from tracewell.session import cut_lineage

# A list of rules up to this size goes to every task, so frequent tokens need no shuffle.
SENT_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    # Rules of a higher rank win, then longer names.
    rank: int = 0


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_ " else "\\" + c for c in text)


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, and paths that start alike."""
    # A literal counts as a token only where the pattern also fixes what follows it.
    tokens = [*host.split("."), *path.split("/")[:-1]]
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{_escaped(host)}{_escaped(path)}",
                tuple(t for t in tokens if t.isascii() and t.isalnum()), rank=1)


BASE_RULES = (
    host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow"),
)
UNWANTED_WORDS = (
    "adult", "porn", "xxx", "sex", "escort", "casino", "poker", "betting", "gambling", "viagra", "cialis", "pharmacy",
    "payday", "torrent", "warez", "keygen", "crack", "malware", "phishing", "proxy",
)
UNWANTED_PARTS = (
    ("wp login", r"/wp-login\.php(?:$|[?#])", ("wp", "login", "php")),
    ("wp admin", r"/wp-admin/", ("wp", "admin")),
    ("cgi", r"/cgi-bin/", ("cgi", "bin")),
    ("cart", r"/(?:shop/)?cart/(?:add|checkout)(?:$|[/?#])", ("cart",)),
    ("reply", r"[?&]replytocom=[0-9]", ("replytocom",)),
    ("session", r"[?&](?:php)?sessi?d?=", ()),
    ("feed", r"/(?:comments/)?feed/?(?:$|[?#])", ("feed",)),
    ("login", r"/(?:user/)?login(?:$|[/?#])", ("login",)),
    ("register", r"/(?:user/)?register(?:$|[/?#])", ("register",)),
    ("program", r"/[^/?#]+\.exe(?:$|[?#])", ("exe",)),
    ("archive", r"/[^/?#]+\.zip(?:$|[?#])", ("zip",)),
    ("advert", r"^(?:ads?|adserver|banners?)[0-9]*\.", ()),
)
PATTERN_RULES = tuple(
    Rule(f"word {w}", "block", rf"(?i)(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)", (w,)) for w in UNWANTED_WORDS
) + tuple(Rule(name, "block", f"(?i){pattern}", tokens) for name, pattern, tokens in UNWANTED_PARTS)
RULES = BASE_RULES + PATTERN_RULES


def url_parts(url: Column) -> dict[str, Column]:
    """``host``, ``path`` and ``tail``: from the first ``://`` on; else empty."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise(F.lit(""))
    return {
        "host": lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "tail": F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1),
    }


def _sent(table: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return F.broadcast(table) if len(rules) <= SENT_RULES else table


def _rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules with the rarest of their tokens; tokens that no URL has are the rarest of all."""
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.tokens) or [""], r.rank) for i, r in enumerate(rules)],
        "rule_no int, name string, verdict string, pattern string, tokens array<string>, rank int")
    wanted = table.select("rule_no", F.explode("tokens").alias("token"))
    names = _sent(wanted.select("token").distinct(), rules)
    counts = urls.select(F.explode("tokens").alias("token")).join(names, "token").groupBy("token").count()
    rarest = wanted.join(counts, "token", "left").groupBy("rule_no").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
    return table.drop("tokens").join(rarest, "rule_no")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rule`` is the longest host rule that fits, else null; its verdict holds. Otherwise
    the URL is blocked if a pattern rule matches and gets ``default`` if none does. A null
    URL or one without ``://`` has empty parts, so only patterns without literals that match
    an empty text could fit. Repeated URLs are judged once. Only ``page_id`` and ``url`` are read.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    parts = rows.select("url").distinct().withColumns(url_parts(F.col("url")))
    parts = parts.withColumn("subject", F.concat("host", "path", "tail"))
    tokens = F.array_append(F.array_distinct(F.regexp_extract_all(lowered(F.col("subject")), F.lit("[a-z0-9]+"), 0)), F.lit(""))
    urls = cut_lineage(parts.withColumn("tokens", tokens))
    fetched = urls.select("url", "subject", F.explode("tokens").alias("token")).join(_sent(cut_lineage(_rule_index(urls, rules)), rules), "token")
    best = fetched.where(F.expr("subject rlike pattern")).groupBy("url").agg(
        F.max(F.struct("rank", F.when(F.col("rank") > 0, F.length("name")).otherwise(0).alias("size"),
                       (F.col("verdict") == "block").alias("block"), "name", "verdict")).alias("best"))
    judged = urls.select("url", "host", "path").join(best, "url", "left").select(
        "url", "host", "path", F.when(F.col("best.rank") > 0, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return rows.join(judged, "url").select("page_id", "host", "path", "rule", "verdict")
