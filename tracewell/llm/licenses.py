"""License scans by ordered signature rules.

A rule is a regular expression over the words of a text, with the keywords that any
match contains, a label, a priority and a score. One pass over a text finds which
keywords it holds; rules are filed under their leading keyword and run only where all their
keywords occur. Detections that lie inside one of the same or a higher priority are
suppressed; of equal ones the earlier rule stays.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tracewell.llm.texts import count_matches, lowered, text_marks
from tracewell.session import cut_lineage

# Letters, digits and all beyond ASCII, in a form that Java tests fast, and all others.
ANY_CASE_WORDS = r"[\p{Alnum}\x{80}-\x{10FFFF}]+"
BETWEEN_WORDS = r"[^\p{Alnum}\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    score: float
    base: bool = False


# Phrases and labels that are always reported.
BASE_SIGNATURES = (
    Signature("mit", "under the mit license", ("mit", "license"), 3, 1.0, base=True),
    Signature("apache-2", "apache license version 2", ("apache", "license", "version"), 3, 1.0, base=True),
    Signature("cc-by-nc", "cc by nc", ("cc", "nc"), 3, 1.0, base=True),
)
# Families: label, leading keyword, names in running text, identifiers, their leading keyword if it is another.
# A joined spelling is a word of its own, so it has its own family.
FAMILIES = (
    ("mit", "mit", "mit(?: expat)?", "mit"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2 0"),
    ("apache-1", "apache", "apache(?: software)?(?: license)?(?: version)? 1(?: [01])?", "apache 1 [01]"),
    ("gpl-2", "gnu", "gnu general public(?: license)?(?: v| version)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gpl"),
    ("gpl-3", "gnu", "gnu general public(?: license)?(?: v| version)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gpl"),
    ("gpl-3", "gpl", "gpl v?3(?: 0)?", "gpl v?3"),
    ("gpl-3", "gplv3", "gplv3(?: 0)?", "gplv3"),
    ("gpl-3", "gpl3", "gpl3(?: 0)?", "gpl3"),
    ("gpl-2", "gpl", "gpl v?2(?: 0)?", "gpl v?2"),
    ("gpl-2", "gplv2", "gplv2(?: 0)?", "gplv2"),
    ("gpl-2", "gpl2", "gpl2(?: 0)?", "gpl2"),
    ("lgpl", "lesser", "gnu lesser general public", "lgpl [23] [01]", "lgpl"),
    ("lgpl", "lgpl", "lgpl(?: v?[23](?: [01])?)?", "lgpl [23] [01](?: only| or later)?"),
    *(("lgpl", f"lgpl{v}", f"lgpl{v}(?: [01])?", None) for v in ("v2", "v3", "2", "3")),
    ("agpl-3", "affero", "gnu affero general public", "agpl 3 0", "agpl"),
    ("agpl-3", "agpl", "agpl(?: v?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    *(("agpl-3", f"agpl{v}", f"agpl{v}(?: 0)?", None) for v in ("v3", "3")),
    ("bsd-2", "bsd", "(?:simplified|2 clause|two clause) bsd", "bsd 2 clause"),
    ("bsd-3", "bsd", "(?:new|modified|revised|3 clause|three clause) bsd", "bsd 3 clause"),
    ("bsd", "bsd", "bsd(?: style)?", "bsd [234] clause"),
    ("mpl-2", "mozilla", "mozilla public(?: license)?(?: v| version)? ?2(?: 0)?", "mpl 2 0", "mpl"),
    ("mpl-1", "mozilla", "mozilla public(?: license)?(?: v| version)? ?1(?: 1)?", "mpl 1 1", "mpl"),
    ("epl", "eclipse", "eclipse public(?: license)?(?: v| version)? ?[12](?: 0)?", "epl [12] 0", "epl"),
    ("eupl", "eupl", "eupl(?: v?1(?: [12])?)?", "eupl 1 [12]"),
    ("cddl", "cddl", "cddl(?: 1(?: [01])?)?", "cddl 1 [01]"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("boost", "boost", "boost software", "bsl 1 0", "bsl"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("artistic", "artistic", "artistic(?: license)?(?: 2(?: 0)?)?", "artistic 2 0"),
    ("ofl", "ofl", "(?:sil )?ofl(?: 1(?: 1)?)?", "ofl 1 1"),
    ("cc0", "cc0", "(?:creative commons )?cc0(?: 1 0)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1234](?: [05])?)?", "cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1234](?: [05])?)?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc", "cc by nc(?: [1234](?: [05])?)?", "cc by nc [1234] [05]"),
    ("cc-by-sa", "cc", "cc by sa(?: [1234](?: [05])?)?", "cc by sa [1234] [05]"),
    ("cc-by-nd", "cc", "cc by nd(?: [1234](?: [05])?)?", "cc by nd [1234] [05]"),
    ("cc-by", "cc", "cc by(?: [1234](?: [05])?)?", "cc by [1234] [05]"),
)
# Statements: keyword, pattern around a family's name or identifier, priority, score.
STATEMENTS = (
    ("spdx", "spdx license identifier {id}", 3, 1.0),
    ("licensed", "(?:dual )?licensed under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 2, 0.95),
    ("released", "released under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 2, 0.95),
    ("distributed", "distributed under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 2, 0.95),
    ("available", "(?:made )?available under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 2, 0.9),
    ("published", "published under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 2, 0.9),
    ("covered", "covered by(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 2, 0.85),
    ("terms", "(?:under|subject to) the terms of(?: the)? {name}(?: licen[cs]e)?", 2, 0.85),
    ("copy", "(?:a )?copy of the {name} licen[cs]e", 1, 0.7),
    ("license", "{name} license", 1, 0.7),
    ("licence", "{name} licence", 1, 0.7),
)
GENERIC = (
    Signature("proprietary", "all rights reserved", ("rights", "reserved"), 0, 0.4),
    Signature("permissive", "permission is hereby granted free of charge", ("permission", "granted"), 1, 0.6),
    Signature("public-domain", "(?:dedicated to|in|into) the public domain", ("public", "domain"), 1, 0.6),
    Signature("warranty", "provided as is without warranty", ("provided", "warranty"), 0, 0.3),
)


def signatures() -> tuple[Signature, ...]:
    """All rules in order: each statement about each family, after the base phrases."""
    made = []
    for keyword, statement, priority, score in STATEMENTS:
        for label, lead, name, identifier, *other in FAMILIES:
            if "{id}" in statement:
                if identifier is None:
                    continue
                lead = other[0] if other else lead
            pattern = statement.format(name=f"(?:{name})", id=f"(?:{identifier})")
            made.append(Signature(label, pattern, (lead, keyword), priority, score))
    return BASE_SIGNATURES + tuple(made) + GENERIC


def _whole_words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def scan_licenses(docs: DataFrame, rules: Sequence[Signature] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row of ``docs``.

    Words are runs of letters and digits, lower-cased in A-Z, counted from 0. ``n_base``
    counts the places of base phrases, ``first_word`` and ``last_word`` are their smallest
    and largest start. ``labels`` adds those of the rules that are not suppressed, ``score``
    is the highest of their scores and of the base phrases, 0 without any. Null and empty texts have no
    words; no labels are an empty text. Repeated texts are scanned once where a keyword occurs. Only
    ``doc_id`` and ``text`` are read.
    """
    rules = signatures() if rules is None else tuple(rules)
    spark, text = docs.sparkSession, F.col("text")
    keywords = sorted({k for r in rules for k in r.keywords})
    # The possessive start test keeps the search to the first letter of words.
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![A-Za-z0-9\x{{80}}-\x{{10FFFF}}])({'|'.join(keywords)})(?![A-Za-z0-9\x{{80}}-\x{{10FFFF}}])"), 1)
    held = docs.select("doc_id", *text_marks(text), count_matches(text, ANY_CASE_WORDS).alias("n_words"),
                       F.array_distinct(F.transform(found, lambda k: lowered(k))).alias("keywords"), "text")
    # A text without two keywords can meet no rule that needs two.
    least = min((len(set(r.keywords)) for r in rules), default=1)
    scanned = cut_lineage(held.select("doc_id", "text_a", "text_b", "n_words", "keywords",
                                      F.when(F.size("keywords") >= least, text).alias("text")))
    table = spark.createDataFrame(
        [(i, r.label, _whole_words(r.pattern), list(r.keywords), r.keywords[0], r.priority, r.score, r.base) for i, r in enumerate(rules)],
        "rule_no int, label string, pattern string, needs array<string>, lead string, priority int, score double, base boolean")
    key = ["text_a", "text_b"]
    gated = scanned.where("text is not null").dropDuplicates(key).select(*key, "keywords", "text")
    fetched = gated.withColumn("lead", F.explode("keywords")).join(table, "lead").where("size(array_except(needs, keywords)) = 0")
    words = F.concat(F.lit(" "), F.regexp_replace(lowered(text), BETWEEN_WORDS, " "), F.lit(" "))
    words = F.regexp_replace(words, "^ +| +$", " ")
    matched = fetched.withColumn("words", words).where(F.expr("words rlike pattern"))
    pieces = matched.select(
        *key, "rule_no", "label", "priority", "score", "base",
        F.posexplode(F.arrays_zip(F.expr("split(words, pattern, -1)").alias("before"),
                                  F.expr("regexp_extract_all(words, pattern, 0)").alias("hit"))).alias("turn", "piece"))
    size = lambda c: count_matches(F.coalesce(F.col(c), F.lit("")), "[^ ]+")
    pieces = pieces.withColumns({"lead_words": size("piece.before"), "hit_words": size("piece.hit")})
    upto = W.partitionBy(*key, "rule_no").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("lead_words") + F.col("hit_words")).over(upto), F.lit(0).cast("long")) + F.col("lead_words")
    places = pieces.withColumn("start", start).where("piece.hit is not null").withColumn("stop", F.col("start") + F.col("hit_words"))
    # In this order whatever holds a place comes before it.
    before = W.partitionBy(*key).orderBy("start", F.col("stop").desc(), F.col("priority").desc(), "rule_no").rowsBetween(
        W.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    inside = F.lit(False)
    for level in levels:
        reach = F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(before)
        inside = F.when(F.col("priority") == level, F.coalesce(reach >= F.col("stop"), F.lit(False))).otherwise(inside)
    judged = places.withColumn("inside", inside)
    some = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    results = judged.groupBy(*key).agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        some(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        some(F.when(F.col("base") | ~F.col("inside"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("base") | ~F.col("inside"), F.col("score"))).alias("score"))
    results = cut_lineage(results)
    nothing = lambda c, value: F.coalesce(F.col(c), F.lit(value)).alias(c)
    return scanned.select("doc_id", *key, "n_words").join(results, key, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        nothing("base_labels", ""), nothing("labels", ""), nothing("score", 0.0))
