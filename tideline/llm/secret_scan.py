"""Secrets in texts: candidates by shape and assignment, false positives removed by a random forest.

Everything is DataFrame functions and Spark ML. Candidates are all long runs of key characters
with a digit in a word (cut at white space), and all values in it that are assigned to a name
such as ``token`` or ``password``. The forest sees its length, the transitions between its
characters, how much of it dictionary words cover, the path (source) of the text and the
neighbouring words. It is trained from labelled findings; without any, findings of the
corpus are labelled where shape and context leave no doubt (``certain_label``).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import durable, table
from tideline.llm.quality_rules import _words

#: Labelled findings that a forest is fitted on, for each label (a bound in expectation).
FIT_ROWS = 4000
TREES, DEPTH, THRESHOLD = 24, 6, 0.5
MARK = "[secret]"

# fixed values: names that hold secrets, context of harmless digests, placeholders, formats
NAMES = "(?i)(token|secret|passw|pwd|api_?-?key|apikey|access_?-?key|private_?-?key|auth|bearer|credential)"
HARMLESS = "(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|revision|etag|uuid|guid|hash|isbn|order|card|phone|invoice)"
PLACEHOLDER = "(?i)(example|placeholder|xxxx|changeme|your|dummy|sample|test|12345678|abcdef|0000000)"
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DICTIONARY = (
    "the and for that with this from have not are was you but all can has more will one about who get which "
    "time when make like than just know take people into year your good some could them see other then now "
    "look only come over think also back after use two how our work first well even new want because any "
    "these give day most user name data file path home page test example sample value key token secret "
    "password admin login server client config local default index image version release build main http "
    "https www com net org html json index number order product account system service request response"
).split()
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
TEST_PATH = "(?i)(test|example|sample|fixture|mock|docs?/)"

_RUN = r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|[A-Za-z0-9+/_-]{12,}={0,2})"
_ASSIGNED = r"^[\"'(\[{]*[A-Za-z_][A-Za-z0-9_.-]*[\"']?(?::=|=>|=|:)[\"']?([^\"'\s,;<>]{8,}?)[\"'\])},;.]*$"
_OPERATOR = r"[A-Za-z0-9_.-]*+[\"']?(?::=|=>|=|:)[\"']?"
_PAIR = NAMES.replace("(?i)(", "(?i)(?:") + _OPERATOR + r"([^\"'\s,;<>&]{8,})"
_CUT = "\x01"
_BARE = r"^[\"'(\[{]*([^\"'\s,;<>]{8,}?)[\"'\])},;.]*$"


def candidates(docs: DataFrame) -> DataFrame:
    """``key, at, part, value`` and the context of every candidate; at counts words from 0.

    part numbers the different values of a word: 0 is that of the whole word or its first run,
    then come the other runs with a digit, then values of names that are in no such run.
    """
    rows = docs.select(
        F.xxhash64("doc_id", "text").alias("key"),
        F.coalesce("source", F.lit("")).alias("path"),
        _words(F.coalesce("text", F.lit(""))).alias("words"),
    )
    word = lambda i: F.get("words", i)
    operator = lambda x: x.isin("=", ":", ":=", "=>")
    named = lambda i: (  # noqa: E731  token = value, token= value, or token=value
        (operator(word(i - 1)) & word(i - 2).rlike(NAMES))
        | (word(i - 1).rlike(r"[:=][\"']?$") & word(i - 1).rlike(NAMES))
        | word(i).rlike(NAMES.replace("(?i)", r"(?i)^[\"'(\[{]*[A-Za-z_.-]*") + r"[A-Za-z0-9_.-]*[\"']?(:=|=>|=|:)[\"']?[^/\s]{8,}")
    )
    shaped = lambda w: w.rlike("[0-9]") & w.rlike(_RUN)
    paired = lambda w: w.rlike("[:=]") & w.rlike(_PAIR)
    at = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (F.length(word(i)) >= 8) & F.coalesce(shaped(word(i)) | named(i) | paired(word(i)), F.lit(False)),
    )
    rows = rows.where(F.size("words") > 0).select("key", "path", "words", F.explode(at).alias("at"))
    i = F.col("at")
    rows = rows.withColumn("named", F.coalesce(named(i), F.lit(False))).select(
        "key", "path", "at", "named",
        word(i).alias("word"),
        F.coalesce(operator(word(i - 1)), F.lit(False)).alias("after_operator"),
        F.concat_ws(" ", word(i - 3), word(i - 2), word(i - 1)).alias("before"),
        F.concat_ws(" ", word(i + 1), word(i + 2)).alias("after"),
    )
    run = F.regexp_extract("word", _RUN, 1)
    inner = F.regexp_extract("word", _ASSIGNED, 1)
    bare = F.regexp_extract("word", _BARE, 1)
    value = (
        F.when(run.rlike("[0-9]"), run)
        .when(F.col("named") & (inner != ""), inner)
        .when(F.col("named") & (bare != ""), bare)
        .otherwise(run)
    )
    # runs of the word at odd places, what is between them at even ones
    pieces = F.split(F.regexp_replace(F.translate("word", _CUT, " "), _RUN, f"{_CUT}$1{_CUT}"), _CUT)
    rows = rows.withColumns({"value": value, "pieces": pieces})
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    ahead = lambda i: F.concat(piece(i - 2), piece(i - 1))  # noqa: E731  a long name is a run too
    assigned = lambda x: x.rlike(NAMES + _OPERATOR + "$")
    part = lambda n, v, is_named, before: F.struct(
        n.cast("int").alias("part"), v.alias("value"), is_named.alias("named"), before.alias("before")
    )
    first = F.array(part(F.lit(0), F.col("value"), F.col("named") | ((F.col("value") == run) & assigned(piece(F.lit(0)))), F.col("before")))
    digits = F.filter(
        F.transform("pieces", lambda x, i: part(i, x, assigned(ahead(i)), ahead(i))),
        lambda x: (x["part"] % 2 == 1) & x["value"].rlike("[0-9]") & (x["value"] != F.col("value")),
    )
    rows = rows.withColumn("runs", F.filter(F.concat(first, digits), lambda x: F.length(x["value"]) >= 8))
    # closing marks do not belong to a value; what holds a run or is within one is there already
    valued = F.transform(
        F.array_distinct(F.regexp_extract_all("word", F.lit(_PAIR), F.lit(1))), lambda x: F.regexp_replace(x, r"[\])}.]+$", "")
    )
    others = F.filter(
        valued,
        lambda v: (F.length(v) >= 8)
        & ~F.exists("runs", lambda r: (F.contains(r["value"], v) | F.contains(v, r["value"])) & (r["named"] | r["value"].rlike("[0-9]"))),
    )
    others = F.transform(others, lambda v, j: part(F.size("pieces") + j, v, F.lit(True), F.lit("")))
    # a first run without a digit stands for a word only if nothing else in it does
    rows = rows.withColumn("all", F.concat("runs", others))
    sure = F.filter("all", lambda x: x["named"] | x["value"].rlike("[0-9]"))
    rows = rows.withColumn("one", F.explode(F.when(F.size(sure) > 0, sure).otherwise(F.col("all"))))
    return rows.select("key", "path", "at", "one.part", "one.named", "word", "after_operator", "one.before", "after", "one.value")


def _share(value: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the numbers that the forest sees; returns their names too."""
    value, low = F.col("value"), F.lower("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a"), "[^9Aa]", "-")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    columns = {
        "f_length": F.length(value).cast("double"),
        "f_digits": _share(value, "[0-9]"),
        "f_upper": _share(value, "[A-Z]"),
        "f_lower": _share(value, "[a-z]"),
        "f_hex": _share(low, "[0-9a-f]"),
        "f_changes": F.length(runs) / F.length(value),
        "f_digit_to_letter": _share(kinds, "9[Aa]"),
        "f_letter_to_digit": _share(kinds, "[Aa]9"),
        "f_case_change": _share(kinds, "aA"),
        "f_bigrams": _share(low, "|".join(BIGRAMS)),
        "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "f_dictionary": _share(low, "|".join(sorted(DICTIONARY, key=len, reverse=True))),
        "f_format": flag(value.rlike(FORMATS)),
        "f_uuid": flag(value.rlike(UUID)),
        "f_slashes": _share(value, "/"),
        "f_path_test": flag(F.col("path").rlike(TEST_PATH)),
        "f_path_depth": F.size(F.split("path", "/")).cast("double"),
        "f_named": flag(F.col("named")),
        "f_operator": flag(F.col("after_operator")),
        "f_quoted": flag(F.col("word").rlike("[\"']")),
        "f_before_name": flag(F.col("before").rlike(NAMES)),
        "f_before_harmless": flag(F.col("before").rlike(HARMLESS)),
        "f_after_harmless": flag(F.col("after").rlike(HARMLESS)),
        "f_before_letters": F.coalesce(_share(F.concat(F.col("before"), F.lit("-")), r"[^\p{L}]"), F.lit(0.0)),
    }
    return found.withColumns(columns), list(columns)


def certain_label(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for a named or well-known secret, 0 for harmless values, else null."""
    value = F.col("value")
    harmless = (
        value.rlike("^[0-9]+$") | value.rlike(UUID) | value.rlike(PLACEHOLDER)
        | (F.col("before").rlike(HARMLESS) & ~F.col("named"))
        | (value.rlike("/.*/") & ~F.col("named"))
    )
    secret = (F.col("named") & value.rlike("[0-9]")) | value.rlike(FORMATS)
    label = F.when(harmless & secret, F.lit(None)).when(secret, 1.0).when(harmless, 0.0)
    return found.withColumn("label", label.cast("double"))


def fit(labelled: DataFrame, names: list[str], fit_rows: int = FIT_ROWS):
    """A forest on distinct labelled findings, about ``fit_rows`` of each label; None without both labels.

    The sample takes the findings with the smallest hashes, so it does not depend on
    partitioning; rows come sorted in one partition, so neither do the trees.
    """
    rows = labelled.where("label is not null").groupBy("value", "label").agg(*[F.max(c).alias(c) for c in names])
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    unit = F.pmod(F.xxhash64("value"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("label") == 1.0, min(1.0, fit_rows / counts[1.0])).otherwise(min(1.0, fit_rows / counts[0.0]))
    sample = rows.where(unit < share).repartition(1).sortWithinPartitions("value", "label")
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.8, minInstancesPerNode=2)
    return forest.fit(vectors)


def secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``key, at, part, value, score, secret`` of every candidate; key is xxhash64(doc_id, text).

    ``docs`` has doc_id, text and source; ``findings`` has the columns of ``candidates`` and a
    label (1 secret, 0 not, null unknown). With labels of one kind only there is no forest, and
    the certain labels decide. Null and empty texts have no candidates; a null source is an
    empty path; repeated rows give the same findings once; extra columns are ignored.
    """
    found, names = features(candidates(docs).dropDuplicates(["key", "at", "part"]))
    found = durable(certain_label(found))
    model = fit(found if findings is None else features(findings)[0], names)
    if model is None:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        rows = VectorAssembler(inputCols=names, outputCol="features").transform(found)
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("key", "at", "part", "value", "score", (F.col("score") >= threshold).alias("secret"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: how many candidates it has, and the findings in text order."""
    found = secrets(docs, findings, threshold)
    listed = found.groupBy("key").agg(
        F.count("*").alias("n_candidates"),
        F.array_sort(F.collect_list(F.when(F.col("secret"), F.struct("at", "part", "value", "score")))).alias("findings"),
    )
    empty = F.array().cast("array<struct<at:int,part:int,value:string,score:double>>")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).join(listed, "key", "left")
    findings_ = F.coalesce("findings", empty)
    return rows.select(
        "doc_id",
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.size(findings_).cast("long").alias("n_secrets"),
        findings_.alias("findings"),
    )


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every occurrence of a found value in its own text as ``[secret]``."""
    found = secrets(docs, findings, threshold).where("secret")
    values = found.groupBy("key").agg(F.collect_set("value").alias("values"))
    longest_first = F.reverse(F.array_sort(F.transform("values", lambda x: F.struct(F.length(x).alias("n"), x.alias("v")))))
    values = values.withColumn("values", F.transform(longest_first, lambda x: x["v"]))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key")).join(values, "key", "left")
    text = F.aggregate("values", F.col("row.text"), lambda t, v: F.replace(t, v, F.lit(MARK)))
    text = F.when(F.col("values").isNull(), F.col("row.text")).otherwise(text)
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    score = F.transform("findings", lambda x: F.round(x["score"], 6))
    return found.select(
        "doc_id", "n_candidates", "n_secrets",
        F.transform("findings", lambda x: x["at"]).alias("word_positions"),
        F.transform("findings", lambda x: F.sha2(x["value"], 256)).alias("value_sha256"),
        score.alias("scores"),
    )


QUERIES = {"op8_secret_scan": op8_secret_scan}
SQL: dict[str, str] = {}
