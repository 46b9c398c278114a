"""Text expressions and term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.scale import attach

# fixed values: patterns of the text features and of the word tokenizer
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = "[.!?]"
WORD = r"[\p{L}\p{N}_]{2,}"


def token_count(text: Column) -> Column:
    """Number of tokens between white space; 0 for blank text. All white space is made one
    character first, so the cut needs no pattern."""
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("int")


def character_count(text: Column) -> Column:
    return F.length(text)


def sentence_mark_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END))


def words(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def text_features(df: DataFrame, text: str = "text", flag: str | None = "flag", prefix: str = "") -> DataFrame:
    """Six text columns: tokens, characters, sentence marks, flag as tinyint, and the
    z-scores (sample deviation, 0 if undefined) of tokens and characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    flagged = F.col(flag).cast("tinyint") if flag in df.columns else F.lit(None).cast("tinyint")
    counted = df.withColumns(
        {
            prefix + "n_tokens": token_count(t),
            prefix + "n_chars": character_count(t),
            prefix + "n_marks": sentence_mark_count(t),
            prefix + "flag_int": flagged,
        }
    )
    return z_scores(counted, {prefix + "n_tokens": prefix + "n_tokens_z", prefix + "n_chars": prefix + "n_chars_z"})


def short_text_features(df: DataFrame, text: str = "text", flag: str = "flag") -> DataFrame:
    """The three-column variant: characters, tokens and flag."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {"n_chars": character_count(t), "n_tokens": token_count(t), "flag_int": F.col(flag).cast("tinyint")}
    )


def z_scores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add whole-table z-scores. The statistics are one row, read as a scalar subquery."""
    parts = []
    for c in columns:
        parts += [F.avg(c).alias("m_" + c), F.stddev_samp(c).alias("s_" + c)]
    stats = F.col("_stats")
    scored = attach(df, "_stats", df.agg(*parts)).withColumns(
        {
            name: F.coalesce(F.try_divide(F.col(c) - stats["m_" + c], stats["s_" + c]), F.lit(0.0))
            for c, name in columns.items()
        }
    )
    return scored.drop("_stats")
