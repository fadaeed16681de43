"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs with a digit, assigned values (``NAME=value`` as in environment files, JSON, YAML, query strings;
``=`` belongs to a value only as padding at its end), passwords of addresses and private-key headers. Each
gets features of its length, its character transitions, how much of it dictionary words
cover, the path (source) it was found under, and the words beside it. The forest is
trained on labelled findings: a table given by the caller, or findings of the corpus
that ``seed_labels`` can label by format and context. Everything runs on DataFrame
expressions and Spark's own forest; no Python runs on executors.

The dictionary holds the words of at least ``min_count`` documents and ``MIN_SHARE`` of all. The
fit uses at most ``labelled`` findings, those with the smallest hash, half of each label.

A document's candidates are placed by the lengths of the texts between them. Rows
are identified by (doc_id, hash of the text); repeated rows are scanned once. Null and empty texts have no
candidates. A null source is an empty path. Without labels of both kinds no forest is
fitted and the probability is the share of label 1 (0 without labels). Columns other
than ``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

CONTEXT = 64
MIN_COUNT = 20
MIN_SHARE = 0.0005
LABELLED = 20_000
TREES, DEPTH, SEED = 40, 8, 3
THRESHOLD = 0.5

#: What a candidate is. Fixed values. The short look-behinds are cheap guards of the long ones after them.
_RUN = r"A-Za-z0-9+_\-"
_ENDS = r"\s\"'`=:,;()<>{}\[\]|"
_AFTER_NAME = r"[=:]>? {0,2}"
CANDIDATE = "|".join(
    [
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
        r"(?<=:)(?<=://[^\s/:@\"']{0,64}:)[^\s/:@\"']{8,}+(?=@)",  # the password of an address
        rf"(?<=[\"'`])(?<={_AFTER_NAME}[\"'`])(?!//)[^{_ENDS}]{{8,}}+={{0,2}}",  # assigned, quoted
        rf"(?<=[=:> ])(?<={_AFTER_NAME})(?!//)[^{_ENDS}&]{{8,}}+={{0,2}}",  # assigned
        r"(?<![A-Za-z0-9+/_.\-])(?=[A-Za-z+/]{0,39}[0-9])(?=[a-z0-9+/]{0,39}[A-Z])(?=[A-Z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}+(?![A-Za-z0-9+/_\-])",
        rf"(?<![{_RUN}])(?=[A-Za-z+_\-]*+[0-9])[{_RUN}]{{16,}}+={{0,2}}",  # a bare run with a digit; a path is several
    ]
)
SECRET_WORDS = "token secret password passwd pwd apikey api key auth authorization bearer credential credentials private access client signing".split()
HARMLESS_WORDS = (
    "sha sha1 sha256 md5 hash commit revision digest checksum etag uuid guid id version build example sample dummy placeholder test phone tel fax card order isbn doi ip http https www".split()
)
#: Prefixes and lengths of tokens that providers give out, and parts of signed JSON tokens.
PROVIDER = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abeprs]-[A-Za-z0-9\-]{10,}"
    r"|AIza[A-Za-z0-9_\-]{35}|[sr]k_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]{13,}(?:\.[A-Za-z0-9_\-]+){0,2})$"
)
PATH_WORDS = "test tests example examples sample doc docs fixture fixtures mock".split()
FEATURES = [
    "n_chars", "digits", "uppers", "lowers", "marks", "hex", "letter_digit", "digit_letter", "case_change", "vowel_pairs", "same_pairs", "longest_letters",
    "covered", "quoted", "assigned", "in_url", "secret_word", "harmless_word", "path_word", "only_digits", "distinct", "key_header", "words_before", "provider",
]


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, path, start, value, before, after): all candidates with up to ``CONTEXT`` characters on both sides."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(source, F.lit("")).alias("path"))
    hit = rows.where(F.col("text").rlike(CANDIDATE))
    parts = F.split("text", CANDIDATE, -1)
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    each = F.transform(
        F.col("found"),
        lambda v, i: F.struct(
            v.alias("value"),
            F.length(F.col("parts")[i]).alias("gap"),
            F.right(F.col("parts")[i], F.lit(CONTEXT)).alias("before"),
            F.left(F.col("parts")[i + 1], F.lit(CONTEXT)).alias("after"),
        ),
    )
    hit = hit.select("doc_id", F.xxhash64("text").alias("row"), "path", parts.alias("parts"), found.alias("found"))
    hit = hit.select("doc_id", "row", "path", F.posexplode(each).alias("at", "c")).select("doc_id", "row", "path", "at", "c.*").distinct()
    so_far = Window.partitionBy("doc_id", "row", "path").orderBy("at")
    start = F.sum(F.col("gap") + F.length("value")).over(so_far) - F.length("value")
    return hit.select("doc_id", "row", "path", start.cast("bigint").alias("start"), "value", "before", "after")


def dictionary(docs: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> DataFrame:
    """Words of 3 to 12 letters in at least ``min_count`` documents and ``min_share`` of all."""
    least = max(min_count, ceil(min_share * docs.count()))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+"))).alias("word"))
    words = words.where(F.length("word").between(3, 12))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the forest's features."""
    value = F.col("value")
    runs = found.select("value").distinct().withColumn("word", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,12}"), F.lit(0))))
    covered = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("in_words")).withColumnRenamed("value", "__value")
    left = F.lower(F.regexp_replace(F.regexp_replace("before", "([a-z])(?=[A-Z])", "$1 "), "[^A-Za-z0-9]+", " "))
    password = F.col("before").rlike(r"://[^\s/:@\"']*:$") & F.col("after").startswith("@")
    beside = F.slice(F.filter(F.reverse(F.split(left, " ")), lambda w: w != ""), 1, 3)
    any_of = lambda words_, column: F.arrays_overlap(column, F.array(*map(F.lit, words_))).cast("double")
    out = found.join(covered, F.col("value") == F.col("__value"), "left").drop("__value").withColumn("beside", beside)
    return out.withColumns(
        {
            "n_chars": F.length(value).cast("double"),
            "digits": _share(value, "[0-9]"),
            "uppers": _share(value, "[A-Z]"),
            "lowers": _share(value, "[a-z]"),
            "marks": _share(value, "[^A-Za-z0-9]"),
            "hex": _share(value, "[0-9a-fA-F]"),
            "letter_digit": _share(value, "[A-Za-z](?=[0-9])"),
            "digit_letter": _share(value, "[0-9](?=[A-Za-z])"),
            "case_change": _share(value, "[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
            "vowel_pairs": _share(value, "(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])"),
            "same_pairs": _share(value, r"(.)(?=\1)"),
            "longest_letters": F.coalesce(F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), F.length)), F.lit(0)).cast("double"),
            "covered": F.coalesce(F.col("in_words"), F.lit(0)) / F.greatest(F.length(value), F.lit(1)),
            "quoted": (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
            "assigned": F.col("before").rlike(r"[=:]>?\s{0,2}[\"'`]?$").cast("double"),
            "in_url": (F.col("before").rlike(r"(?i)(https?:|www\.)[^\s=]*$") & ~password).cast("double"),
            "secret_word": F.greatest(any_of(SECRET_WORDS, F.col("beside")), password.cast("double")),
            "harmless_word": F.when(password, 0.0).otherwise(any_of(HARMLESS_WORDS, F.col("beside"))),
            "path_word": any_of(PATH_WORDS, F.split(F.lower("path"), "[^a-z]+")),
            "only_digits": value.rlike("^[0-9]+$").cast("double"),
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
            "key_header": value.startswith("-----BEGIN").cast("double"),
            "words_before": F.size("beside").cast("double"),
            "provider": value.rlike(PROVIDER).cast("double"),
        }
    )


def seed_labels(features: DataFrame) -> DataFrame:
    """Findings that format and context label beyond doubt: ``label`` 1 or 0; the rest are left out.

    1: key headers, and outside tests providers' tokens and random-looking values assigned to a secret's name.
    0: plain numbers, values in addresses or beside harmless words, and values made of dictionary words or without
    digits unless they are assigned to a secret's name. Other values without an assignment are left out.
    """
    random = (F.col("digits") > 0.05) & (F.col("covered") < 0.5) & (F.col("n_chars") >= 16) & (F.col("only_digits") == 0)
    named = (F.col("secret_word") == 1) & (F.col("assigned") == 1)
    one = (F.col("key_header") == 1) | (((named & random) | (F.col("provider") == 1)) & (F.col("harmless_word") == 0) & (F.col("path_word") == 0))
    plain = (F.col("only_digits") == 1) | (((F.col("covered") >= 0.8) | (F.col("digits") == 0)) & ~named)
    zero = (F.col("provider") == 0) & (plain | (F.col("in_url") == 1) | ((F.col("secret_word") == 0) & (F.col("harmless_word") == 1)))
    return features.withColumn("label", F.when(one, 1.0).when(zero, 0.0)).where("label IS NOT NULL")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, sample: int = LABELLED, min_count: int = MIN_COUNT) -> DataFrame:
    """All candidates with ``probability`` and ``is_secret``.

    ``labelled``: findings (value, before, after, path, label), e.g. reviewed ones.
    """
    found = durable(candidates(docs))
    words = durable(dictionary(docs, min_count))
    features = durable(with_features(found, words))
    known = seed_labels(features) if labelled is None else with_features(labelled.select("value", "before", "after", "path", "label"), words)
    one_each = known.withColumn("__order", F.xxhash64("value", "before", F.lit(SEED)))
    half = lambda label: one_each.where(F.col("label") == label).orderBy("__order").limit(sample // 2)
    training = durable(half(1.0).unionByName(half(0.0)).select(*FEATURES, "label"))
    counts = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        scored = features.withColumn("probability", F.lit(float(bool(counts.get(1.0)))))
    else:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="__features")
        forest = RandomForestClassifier(
            featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__label"
        ).fit(assemble.transform(training))
        scored = forest.transform(assemble.transform(features)).withColumn("probability", vector_to_array("__p")[1])
    return scored.select(
        "doc_id", "row", "path", "start", "value", "before", "after", "probability", (F.col("probability") >= threshold).alias("is_secret")
    )


def redacted(text: Column, value: Column) -> Column:
    """The text with a secret's characters replaced."""
    return F.replace(text, value, F.repeat(F.lit("*"), F.length(value)))
