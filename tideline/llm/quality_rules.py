"""Quality rules: base counts of a text, and lines that too many documents of a host share.

Everything is built-in expressions. Lines are normalised (lower case, digits as 0, white
space as single spaces, trimmed) and hashed to 96 bits. Documents are counted per host and
line; exact copies of a text count as one document. A line in more than ``min_docs``
documents and more than ``share`` of its host's documents is removed, and a document that
keeps less than ``keep_share`` of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import durable, table

SPACES = " \t\n\x0b\f\r"
SALTS = 16
MIN_DOCS, SHARE, KEEP_SHARE = 10, 0.05, 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _with_word(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x, F.lit(SPACES)) != "")


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``words, n_words``; exact.

    Windows are sorted as one long each, hash above position; only windows whose hashes meet
    are compared as strings.
    """
    docs = docs.withColumn("bits", F.length(F.bin("n_words")))
    packed = F.transform(
        F.slice("words", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
        lambda x, i: F.call_function(
            "shiftleft", F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)), F.col("bits")
        ).bitwiseOR(i.cast("long")),
    )
    docs = docs.withColumn("packed", F.sort_array(packed))
    top = lambda x: F.call_function("shiftrightunsigned", x, F.col("bits"))
    meet = F.filter(
        "packed",
        lambda x, i: (top(F.get("packed", i - 1)) == top(x)) | (top(F.get("packed", i + 1)) == top(x)),
    )
    at = lambda x: (x - F.call_function("shiftleft", top(x), F.col("bits"))).cast("int")
    window = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    docs = docs.withColumn("meet", F.transform(meet, at))
    docs = docs.withColumn(
        "sure", F.sort_array(F.transform("meet", lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    )
    again = F.filter(
        "sure",
        lambda x, i: (F.get("sure", i - 1)["w"] == x["w"]) | (F.get("sure", i + 1)["w"] == x["w"]),
    )
    docs = docs.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("again", lambda x, i: F.least(F.lit(3), F.get("again", i + 1) - x).cast("long"))
    docs = docs.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return docs.drop("bits", "packed", "meet", "sure", "again", "words")


def _keyed(docs: DataFrame) -> DataFrame:
    """Null texts as empty; the host; keys of the document and of its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        text.alias("text"),
        F.coalesce("source", F.lit("")).alias("host"),
        F.xxhash64("doc_id", "source", text).alias("key"),
        F.hash(text, "doc_id").alias("key2"),
        F.xxhash64(text).alias("copy"),
    )


def _normal_lines(text: Column) -> Column:
    flat = F.translate(F.lower(text), "123456789" + SPACES.replace("\n", ""), "0" * 9 + " " * 5)
    return F.split(F.regexp_replace(flat, " {2,}", " "), "\n")


def _line_rows(keyed: DataFrame) -> DataFrame:
    """One row per line with a word: its host, hashes, position and number of words."""
    lines = F.transform(
        _normal_lines(F.col("text")),
        lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("at")),
    )
    lines = F.transform(
        F.filter(lines, lambda x: x["x"] != ""),
        lambda x: F.struct(
            F.xxhash64(x["x"]).alias("h"),
            F.hash(x["x"]).alias("h2"),
            F.size(F.split(x["x"], " ")).alias("n"),
            x["at"].alias("at"),
        ),
    )
    return keyed.select("host", "key", "key2", "copy", F.explode(lines).alias("line")).select(
        "host", "key", "key2", "copy", "line.*"
    )


def frequent_lines(keyed: DataFrame, min_docs: int, share: float) -> DataFrame:
    """``host, h, h2`` of the lines above the limits."""
    counts = (
        _line_rows(keyed).select("host", "h", "h2", "copy").distinct().groupBy("host", "h", "h2").agg(F.count("*").alias("docs"))
    ).where(F.col("docs") > min_docs)
    hosts = keyed.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("all"))
    return counts.join(hosts, "host").where(F.col("docs") > share * F.col("all")).select("host", "h", "h2")


def removed_lines(docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """``key, key2, removed_words, removed_at`` of the documents with such lines.

    A line may be in a third of all documents: its rows are spread over ``SALTS`` keys.
    """
    keyed = _keyed(docs)
    salted = frequent_lines(keyed, min_docs, share).select(
        "host", "h", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    rows = _line_rows(keyed).withColumn("salt", F.pmod("key2", F.lit(SALTS)))
    hit = rows.join(salted, ["host", "h", "h2", "salt"]).groupBy("key", "key2", "at").agg(F.max("n").alias("n"))
    return hit.groupBy("key", "key2").agg(
        F.sum("n").alias("removed_words"), F.collect_list("at").alias("removed_at")
    )


def base_counts(keyed: DataFrame) -> DataFrame:
    """Adds the base counts of the whole text and drops it."""
    bare = F.length(F.translate("text", SPACES, ""))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    docs = keyed.withColumns(
        {
            "word_chars": bare.cast("long"),
            "n_symbols": symbols.cast("long"),
            "lines": _with_word(F.split("text", "\n")),
            "words": _words(F.col("text")),
        }
    )
    docs = docs.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines", "text")
    docs = _repeated_words(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def quality(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, keep_share: float = KEEP_SHARE
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``: base counts and the verdict.

    A null text counts as empty and fails the base rule; a null source is the host ''. Rows
    that repeat a document are all returned, and counted once. Extra columns are ignored; an
    empty table gives an empty result. Write the result before filtering on ``kept``: the filter
    would else be pushed into the counts and evaluate their nested expressions per word.
    """
    out = base_counts(_keyed(docs)).join(removed_lines(docs, min_docs, share), ["key", "key2"], "left")
    removed = F.coalesce("removed_words", F.lit(0))
    depleted = F.col("n_words") - removed < keep_share * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        removed.alias("n_removed_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def clean(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, keep_share: float = KEEP_SHARE
) -> DataFrame:
    """The rows that ``quality`` keeps, without the removed lines in text; other columns as given.

    The verdicts are written first: a filter on them would else be pushed below the counts and
    evaluate their nested expressions again and again.
    """
    counted = base_counts(_keyed(docs)).join(removed_lines(docs, min_docs, share), ["key", "key2"], "left")
    left_over = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    verdicts = durable(
        counted.select(
            "key", "key2", "removed_at", (~F.col("base_failed") & (left_over >= keep_share * F.col("n_words"))).alias("kept")
        )
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.xxhash64("doc_id", "source", text).alias("key"),
        F.hash(text, "doc_id").alias("key2"),
    ).join(verdicts.where("kept").dropDuplicates(["key", "key2"]), ["key", "key2"])
    lines = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed_at", i))
    kept = F.when(F.col("removed_at").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    return rows.select(F.col("row").withField("text", kept).alias("row")).select("row.*")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {
    "op1_quality_rules": f"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
        translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS flat
    FROM documents
), w AS (
    SELECT doc_id, host, text, list_filter(string_split(flat, ' '), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)),
            lambda x: trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '') AS lines,
        length(replace(flat, ' ', '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
    FROM d
), grams AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), repeated AS (
    SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2
), covered AS (
    SELECT doc_id, count(DISTINCT i + o) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id
), lines AS (
    SELECT doc_id, host, text, trim(regexp_replace(
        translate(lower(line), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '),
        ' +', ' ', 'g')) AS line
    FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
), counted AS (
    SELECT host, line, count(DISTINCT text) AS docs FROM lines WHERE line <> '' GROUP BY host, line
), hosts AS (
    SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host
), removed AS (
    SELECT doc_id, sum(len(string_split(line, ' '))) AS n
    FROM lines JOIN counted USING (host, line) JOIN hosts USING (host)
    WHERE docs > {MIN_DOCS} AND docs > {SHARE} * hosts.n
    GROUP BY doc_id
), base AS (
    SELECT doc_id, len(words) AS n_words, word_chars, n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
        coalesce(removed.n, 0) AS n_removed_words
    FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(n_removed_words AS BIGINT) AS n_removed_words,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND n_words - n_removed_words >= {KEEP_SHARE} * n_words AS kept
FROM base
""",
}
