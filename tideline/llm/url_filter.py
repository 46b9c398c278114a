"""URL filter: host and path rules first, then a character language-model ratio.

URLs that a rule decides teach two variable-order Markov models of characters, one of accepted
and one of rejected URLs. A context of up to ``ORDER`` characters gives the next character's
probability by Witten-Bell smoothing: the longest context backs off to the next shorter one
down to equal chances. The difference of the mean log-likelihoods per character decides the
other URLs at the threshold that errs least on ruled URLs which are not in the counts.

All is DataFrame functions but the scoring, which looks up hashed counts of ``2 ** BITS``
places per order, the bounded size of a model, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import fold_ascii, table
from tideline.llm.fitting import Packed, unit
from tideline.llm.words import mix, slices, text_buffer

ORDER, BITS, HELD, BINS = 5, 18, 0.2, 512


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for the URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return fold_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host, path`` and of the longest rule that fits ``rule`` and ``by_rule``; null without one."""
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # longer ones are looked at first
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule = F.when(fits, r.text).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumns({"rule": rule, "by_rule": verdict})


def _keys(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order k: the owner of each byte, the place of its context of k bytes, and of context and byte."""
    raw, ptr = text_buffer(texts)
    n = np.diff(ptr)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(raw)) - np.repeat(ptr[:-1], n)
    x = raw.astype(np.uint64) + np.uint64(1)
    context = np.zeros(len(raw), np.uint64)
    for k in range(ORDER + 1):
        if k:
            # bytes before the start of a URL count as 0, so the start is a context too
            before = np.zeros(len(raw), np.uint64)
            before[k:] = x[:-k]
            before[within < k] = 0
            context = context + (before << np.uint64(9 * k))
        c = mix(context + np.uint64(k + 1))
        both = mix(c ^ (x * np.uint64(0x9E3779B97F4A7C15)))
        shift = np.uint64(64 - BITS)
        yield k, owner, (c >> shift).astype(np.int64), (both >> shift).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "url"):
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for k, owner, _, both in _keys(part.column("url")):
                key, n = np.unique(label[owner] << 40 | np.int64(k) << 32 | both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["place", "n"])
            for k, owner, c, both in _keys(part.column("url")):
                key = np.unique(label[owner] << 60 | np.int64(k) << 56 | c << 28 | both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(-1 - key), pa.array(np.ones(len(key), np.int64))], names=["place", "n"]
                )


class Model:
    """Counts of one class by order: of context and next byte, of contexts, and of kinds of next byte."""

    def __init__(self):
        self.both, self.total, self.kinds = (Packed(np.zeros((ORDER + 1, 1 << BITS), np.float32)) for _ in range(3))

    def log(self, keys) -> np.ndarray:
        p = None
        for k, _, c, both in keys:
            p = np.full(len(c), 1 / 256) if p is None else p
            total, kinds = self.total.values[k][c], self.kinds.values[k][c]
            p = np.where(total > 0, (self.both.values[k][both] + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.log(p) if p is not None else np.zeros(0)


def differences(models: tuple[Model, Model], texts) -> np.ndarray:
    """Mean log-likelihood per byte under the accepted less under the rejected model; 0 for empty."""
    keys = list(_keys(texts))
    ratio = models[0].log(keys) - models[1].log(keys)
    _, ptr = text_buffer(texts)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    return (total[ptr[1:]] - total[ptr[:-1]]) / np.maximum(np.diff(ptr), 1)


def _with_difference(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url"):
                d = differences(shared.value, part.column("url"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d)], names=[*part.schema.names, "difference"])

    return run


def fit(pages: DataFrame) -> tuple[tuple[Model, Model], float] | None:
    """Models of accepted and rejected URLs and the threshold, from ``url, by_rule``; None without both."""
    known = pages.where("by_rule is not null and url is not null").select(
        "url", (F.col("by_rule") == "block").cast("int").alias("label")
    ).distinct()
    held = unit("url") < HELD
    counted = known.where(~held).mapInArrow(_counts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    # a pair of context and byte counts once as a kind, however many tasks saw it
    got = counted.select("place", F.when(F.col("place") < 0, 1).otherwise(F.col("n")).alias("n"))
    kinds = got.where("place < 0").select(F.shiftright(-1 - F.col("place"), 28).alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    models = (Model(), Model())
    mask = (1 << BITS) - 1
    counts = got.where("place >= 0").toPandas()  # at most 2 * (ORDER + 1) * 2 ** BITS rows each
    kinds = kinds.toPandas()
    if not len(counts):
        return None
    p, n = counts["place"].to_numpy(np.int64), counts["n"].to_numpy(float)
    for label, model in enumerate(models):
        own = (p >> 40) == label
        if not own.any():
            return None
        model.both.values[(p[own] >> 32) & 255, p[own] & mask] = n[own]
        q, m = kinds["place"].to_numpy(np.int64), kinds["n"].to_numpy(float)
        mine = (q >> 32) == label
        model.kinds.values[(q[mine] >> 28) & 15, q[mine] & mask] = m[mine]
    totals = known.where(~held).mapInArrow(_contexts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    t, n = totals["place"].to_numpy(np.int64), totals["n"].to_numpy(float)
    for label, model in enumerate(models):
        own = (t >> 40) == label
        model.total.values[(t[own] >> 32) & 255, t[own] & mask] = n[own]
    shared = pages.sparkSession.sparkContext.broadcast(models)
    scored = known.where(held).mapInArrow(_with_difference(shared), "url string, label int, difference double")
    # the threshold that errs least, both labels weighing the same; counts in bins only
    step = 4.0 / BINS
    place = F.floor((F.greatest(F.least("difference", F.lit(2 - 1e-9)), F.lit(-2.0)) + 2) / step).cast("int")
    bins = scored.groupBy(place.alias("bin"), "label").agg(F.count("*").alias("n")).collect()
    count = np.zeros((2, BINS))
    for row in bins:
        count[row["label"], row["bin"]] = row["n"]
    share = count / np.maximum(count.sum(1, keepdims=True), 1)
    wrong = np.concatenate([[0.0], np.cumsum(share[0])]) + np.concatenate([np.cumsum(share[1][::-1])[::-1], [0.0]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return models, float(best[len(best) // 2] * step - 2)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "url"):
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for k, owner, c, _ in _keys(part.column("url")):
                key, n = np.unique(label[owner] << 40 | np.int64(k) << 32 | c, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["place", "n"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, difference`` of every row of ``pages(page_id, url, ...)``.

    A null URL, or one without ``://``, has an empty host and path and no rule; a null URL has
    the difference 0. Without ruled URLs of both verdicts nothing is learned and all other URLs
    are allowed. Repeated rows are judged each; extra columns are ignored.
    """
    rows = ruled(pages.select("page_id", "url"), rules)
    learned = fit(rows)
    if learned is None:
        out = rows.withColumn("difference", F.lit(0.0))
        other = F.lit("allow")
    else:
        models, threshold = learned
        shared = pages.sparkSession.sparkContext.broadcast(models)
        out = rows.mapInArrow(
            _with_difference(shared),
            "page_id long, url string, host string, path string, rule string, by_rule string, difference double",
        )
        other = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", other).alias("verdict"), "difference")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages")).withColumn("difference", F.round("difference", 9))


QUERIES = {"op6_url_filter": op6_url_filter}
SQL: dict[str, str] = {}
