"""Secret scans: pattern candidates, judged by a random forest trained from labelled findings.

Candidates are strings that look like credentials. Each is described by its length, the
transitions between kinds of characters, the share that corpus words cover, its
document's path (``source``) and the neighbouring words; the forest (MLlib) tells
secrets from false positives. All of it runs as DataFrame operations in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewell.llm.texts import text_marks
from tracewell.session import cut_lineage

SECRET_NAMES = "pass(?:word|wd)?|pwd|secret|token|api.?key|access.?key|credential|auth(?:orization)?|bearer|private"
SECRET_WORDS = rf"(?i)(?:{SECRET_NAMES})"
# After a secret's name and a sign of assignment; the short test comes first, since it fails almost everywhere.
ASSIGNED = rf"""(?<=[=:]\s{{0,3}}["']?)(?<=(?i:{SECRET_NAMES}|[._-]key)["']?\s{{0,3}}[=:]{{1,2}}\s{{0,3}}["']?)"""
KEY_EDGE = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
# Formats: kind and pattern. The order decides which of two that start alike is taken.
FORMATS = (
    ("key_block", rf"-----BEGIN {KEY_EDGE}(?:[A-Za-z0-9+/=\s:,.\\()-]*?-----END {KEY_EDGE})?"),
    ("aws", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    ("openai", r"sk-proj-[A-Za-z0-9_-]{20,}"),
    ("npm", r"npm_[A-Za-z0-9]{36,}"),
    ("huggingface", r"hf_[A-Za-z0-9]{30,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google", r"AIza[0-9A-Za-z_-]{35}"),
    ("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # Values in quotes go up to the quote, others up to a space or separator.
    ("assigned", ASSIGNED + r"""(?:(?<=")[^"\n]+(?=")|(?<=')[^'\n]+(?=')|(?<!["'])[^\s"'`,;<>]+)"""),
    ("hex", r"[0-9a-fA-F]{16,}"),
    # With = at the end only, so that a name before it is not part of the value; or with = anywhere after letters and digits.
    ("mixed", r"(?=[A-Za-z_/+-]*[0-9])(?=[0-9_/+-]*[A-Za-z])[A-Za-z0-9_/+-]{14,}={0,2}"),
    ("mixed", r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9_/+=-]{14,}"),
)
# Formats that are enough to call a string a secret.
KNOWN = tuple(p for kind, p in FORMATS if kind not in ("assigned", "hex", "mixed"))
# A search starts only at the edge of a word.
CANDIDATE = "(?<![A-Za-z0-9_/+-])(?:" + "|".join(f"({p})" for _, p in FORMATS) + ")(?![A-Za-z0-9_/+=-])"
HARMLESS_WORDS = r"(?i)(?:example|sample|dummy|placeholder|your|changeme|test|fake|sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|etag|revision)"
TEST_PATHS = r"(?i)(?:test|example|sample|fixture|mock|docs?/)"
FEATURES = ("length", "distinct", "digits", "uppers", "hexes", "changes", "covered", "assigned", "secret_words", "harmless_words", "test_path", "in_path")
TRAINING_ROWS = 20_000
TREES, TREE_DEPTH, SEED = 20, 6, 17
SHORTEST_WORD, LONGEST_WORD = 3, 20
WORD_SHARE = 1e-7


def candidates(docs: DataFrame) -> DataFrame:
    """``text_a, text_b, source, turn, start, before, candidate, after`` of each distinct text.

    ``start`` counts characters from 0, ``before`` and ``after`` are the 40 characters around.
    """
    key = ["text_a", "text_b"]
    held = docs.select("source", *text_marks(F.col("text")), "text").where(F.col("text").rlike(CANDIDATE))
    # Repeated texts are scanned once; their path is the first in order.
    once = cut_lineage(held.groupBy(*key).agg(F.min("source").alias("source"), F.min("text").alias("text")))
    pieces = once.select(*key, "source", F.posexplode(F.arrays_zip(
        F.split("text", CANDIDATE, -1).alias("before"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("candidate"),
    )).alias("turn", "piece")).select(*key, "source", "turn", "piece.before", "piece.candidate")
    order = W.partitionBy(*key).orderBy("turn")
    size = F.char_length("before") + F.coalesce(F.char_length("candidate"), F.lit(0))
    start = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")) + F.char_length("before")
    following = F.substring(F.lead("before").over(order), 1, 40)
    return pieces.select(*key, "source", "turn", start.alias("start"), F.right("before", F.lit(40)).alias("before"), "candidate", following.alias("after")).where(
        "candidate is not null")


def _share(column: str, pattern: str) -> Column:
    return F.regexp_count(column, F.lit(pattern)) / F.char_length(column)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{SHORTEST_WORD},}}"), 0)


def _coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``candidate, covered``: the share of its characters in words that the corpus uses as words."""
    runs = found.select("candidate").distinct().select("candidate", F.explode(_words(F.col("candidate"))).alias("word"))
    wanted = cut_lineage(runs.select("word").where(F.length("word") <= LONGEST_WORD).distinct())
    # Words of the corpus stand between white space; the words asked for are few and met before they are summed.
    tokens = docs.select(F.explode(F.split(F.lower("text"), r"[\s.,;:!?]+")).alias("word")).join(wanted, "word").groupBy("word").count()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = tokens.where(F.col("count") > F.lit(max(1.0, WORD_SHARE * total))).select("word", F.lit(True).alias("known"))
    return runs.join(known, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("letters")).select(
        "candidate", (F.col("letters") / F.char_length("candidate")).alias("covered"))


def describe(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the feature columns to candidates."""
    changes = r"(?<=[a-z])(?=[A-Z0-9_/+=-])|(?<=[A-Z])(?=[a-z0-9_/+=-])|(?<=[0-9])(?=[A-Za-z_/+=-])|(?<=[_/+=-])(?=[A-Za-z0-9])"
    joined = found.join(_coverage(found, docs), "candidate", "left")
    close = F.concat(F.right("before", F.lit(24)), F.lit(" "), F.left(F.coalesce("after", F.lit("")), F.lit(16)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    size = F.char_length("candidate")
    return joined.withColumns({
        "length": size.cast("double"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.least(size, F.lit(40)),
        "digits": _share("candidate", "[0-9]"), "uppers": _share("candidate", "[A-Z]"), "hexes": _share("candidate", "[0-9a-f]"),
        "changes": F.regexp_count("candidate", F.lit(changes)) / size,
        "covered": F.coalesce("covered", F.lit(0.0)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
        "secret_words": flag(F.right("before", F.lit(24)).rlike(SECRET_WORDS)), "harmless_words": flag(close.rlike(HARMLESS_WORDS)),
        "test_path": flag(F.col("source").rlike(TEST_PATHS)), "in_path": flag(F.col("before").rlike(r"[/\\.@]$")),
    })


def label_findings(described: DataFrame) -> DataFrame:
    """Findings whose case is plain, with ``label``: 1 for secrets, 0 for false positives.

    Known key formats and values assigned to a secret's name, unless words around call them
    examples, are secrets. Numbers, dictionary words, repeated characters and strings that
    words around call digests or examples are not.
    """
    known = F.col("candidate").rlike("^(?:" + "|".join(KNOWN) + ")$")
    plain = (F.col("harmless_words") == 0) & (F.col("distinct") > 0.25)
    # Assigned values without digits that are mostly words are left to the forest.
    coded = (F.col("digits") > 0) | (F.col("covered") <= 0.6)
    secret = plain & (known | ((F.col("assigned") == 1) & (F.col("secret_words") == 1) & coded))
    false = (F.col("harmless_words") == 1) | (F.col("digits") == 1) | (F.col("covered") > 0.6) | (F.col("distinct") <= 0.25) | (
        (F.col("secret_words") == 0) & (F.col("assigned") == 0) & ~known)
    return described.withColumn("label", F.when(secret, 1.0).when(false, 0.0)).where("label is not null")


def train(labelled: DataFrame, rows: int = TRAINING_ROWS) -> RandomForestClassificationModel | float:
    """Forest from at most ``rows`` labelled findings, taken by hash and half of each label.

    With one label only there is nothing to learn: the result is that label, or 0 without findings.
    """
    turn = W.partitionBy("label", "slice").orderBy(F.xxhash64("candidate"), "before", "start")
    slices = 16
    taken = labelled.withColumn("slice", F.pmod(F.xxhash64("candidate", "start"), F.lit(slices))).withColumn(
        "turn", F.row_number().over(turn)).where(F.col("turn") <= rows // (2 * slices))
    vectors = cut_lineage(taken.select("label", *FEATURES))
    labels = [r.label for r in vectors.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(vectors))


def judge(described: DataFrame, model) -> DataFrame:
    """Add ``score``, the forest's share of votes for a secret."""
    if isinstance(model, float):
        return described.withColumn("score", F.lit(model))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, candidate, score, is_secret`` of every candidate in every row of ``docs``.

    ``labelled`` are findings with ``label`` and the feature columns; without them those of
    ``docs`` whose case is plain are used. Null and empty texts have no candidates, a null
    ``source`` is no test path. Repeated rows are reported as often as they occur. Only
    ``doc_id, source, text`` are read.
    """
    found = cut_lineage(candidates(docs))
    described = cut_lineage(describe(found, docs))
    model = train(label_findings(described) if labelled is None else labelled)
    judged = cut_lineage(judge(described, model).select("text_a", "text_b", "start", "candidate", "score"))
    rows = docs.select("doc_id", *text_marks(F.col("text")))
    return rows.join(judged, ["text_a", "text_b"]).select(
        "doc_id", "start", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
