"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Words are lower-cased runs of letters and digits, a stem is the first ``STEM`` bytes of a word.
All words of the corpus are counted. The model holds those of the labelled texts, and of any
other word the stem: with no count in a class, its share of the stem is a factor of both classes,
so it drops out of their ratio, and so does that of a stem that no labelled text has. No word,
stem or pair is left out for being rare, and the model grows with the labelled texts. Each class has pair counts, which back off to the number of different
left neighbours of a word in the class (one drawn from each text), then to that of its stem in the class, then to counts
of the whole corpus, which both classes share; so rare words of a stem stand in for another:

    P_c(w | u) = (n_c(u, w) - D + rest_c(u) P_c(w)) / n_c(u)
    P_c(w)     = (k_c(w) - D + rest_c P_c(stem) S(w | stem)) / K_c
    P_c(stem)  = (k_c(stem) - D + rest'_c S(stem)) / K_c

n counts the different words before a pair, one from each text, so that neither texts which
repeat themselves nor copies count again. D is above the counts that chance gives to rare
words. Features of a text are the mean of log P_toxic - log P_ordinary per word, less the
text's median (all words of a language or topic that one class has more of share a shift that
says nothing on this text), the mean of what is above ``CLEAR``, and both against chance (times
the root of the length). A logistic curve over them, calibrated on labelled documents that are
not in the counts, gives the score. Class counts come from equally many labelled documents of each class, at most about
``FIT_ROWS``; corpus counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import crc_bucket, durable, table
from tideline.llm.fitting import labelled_sample, logistic, sigmoid, unit
from tideline.llm.words import ALNUM, LOWER, chain, hashed_words, mix, owner, slices, text_buffer

#: Labelled documents per class.
FIT_ROWS = 12000
STEM, HELD, CLEAR, FEATURES = 6, 0.25, 1.0, 5
#: Discounts to choose from, by the log-loss on labelled documents that are not in the counts.
DISCOUNTS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
_WIDTH = 32  # bits of a word number


def word_keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ptr, hashes, stems``: a stem is its bytes as a number."""
    ptr, h, start, end = hashed_words(texts, ALNUM, LOWER, spans=True)
    raw, _ = text_buffer(texts)
    stem = np.zeros(len(h), np.uint64)
    for k in range(STEM):
        at = start + k
        inside = at < end
        letter = np.where(inside, LOWER[raw[np.where(inside, at, 0)]], 0) if len(raw) else stem
        stem = stem << np.uint64(8) | letter.astype(np.uint64)
    return ptr, h, stem


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, stems, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merged(w, s, n):
        order = np.argsort(w, kind="stable")
        w, s, n = w[order], s[order], n[order]
        lead = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
        return w[lead], s[lead], np.add.reduceat(n, lead) if len(lead) else n[:0]

    def out():
        columns = [words.view(np.int64), stems.view(np.int64), counts]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "stem", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            _, h, stem = word_keys(part.column("text"))
            w, at, n = np.unique(h, return_index=True, return_counts=True)
            own = (words, w), (stems, stem[at]), (counts, n)
            words, stems, counts = merged(*[np.concatenate(x) for x in own])
            if len(words) > 1 << 20:
                yield out()
                words, stems, counts = words[:0], stems[:0], counts[:0]
    yield out()


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of each value, -1 where it is not there."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


class Vocabulary:
    """Numbers of expressions: the words, then for each stem its other words (the first stem is unknown).

    ``stem_of`` gives the stem of each number, ``shared`` the corpus probability of the stems,
    ``within`` that of an expression given its stem.
    """

    def __init__(self, words, word_stems, counts, stems, stem_counts, total: int):
        order, stem_order = np.argsort(words), np.argsort(stems)
        self.words, self.stems = words[order], stems[stem_order]
        of_word = _find(self.stems, word_stems[order]) + 1
        n_stems = len(self.stems) + 1
        self.stem_of = np.concatenate([of_word, np.arange(n_stems)])
        per_stem = np.concatenate([[max(total - stem_counts.sum(), 0)], stem_counts[stem_order]]).astype(float)
        held = np.bincount(of_word, counts[order], minlength=n_stems)
        n = np.concatenate([counts[order], np.maximum(per_stem - held, 0)]) + 0.5
        sums = np.bincount(self.stem_of, n)
        self.within = n / sums[self.stem_of]
        self.shared = sums / sums.sum()

    def numbers(self, texts) -> tuple[np.ndarray, np.ndarray]:
        ptr, h, stem = word_keys(texts)
        word = _find(self.words, h)
        return ptr, np.where(word >= 0, word, len(self.words) + _find(self.stems, stem) + 1)


def _pairs(ptr: np.ndarray, ids: np.ndarray, start: int) -> np.ndarray:
    """Left and right word numbers of every word as one long; the first has the start sign at left."""
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    left[ptr[:-1][np.diff(ptr) > 0]] = start
    return left << _WIDTH | ids


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two min-hashes of the runs of three words; near copies agree in one of them at least mostly."""
    for batch in batches:
        for part in slices(batch, "text"):
            ptr, h = hashed_words(part.column("text"), ALNUM, LOWER)
            runs = chain(chain(h[:-2], h[1:-1]), h[2:]) if len(h) > 2 else h[:0]
            marks = np.zeros((2, part.num_rows), np.uint64)
            for i, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
                own = runs[a : b - 2] if b - a > 2 else mix(h[a:b] + np.uint64(i))
                if len(own):
                    marks[:, i] = own.min(), mix(own).min()
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("doc_id", "text", "label")] + [pa.array(m.view(np.int64)) for m in marks],
                names=["doc_id", "text", "label", "mark1", "mark2"],
            )


def _class_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ptr, ids = vocabulary.numbers(part.column("text"))
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                pair = _pairs(ptr, ids, len(vocabulary.stem_of))
                doc = owner(ptr)
                before = np.append(0, pair[:-1] >> _WIDTH) if len(pair) else pair
                # each pair of a text with the word before it where it comes first
                order = np.lexsort((pair, doc))
                lead = np.append(True, (pair[order][1:] != pair[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
                once = order[lead[: len(order)]]
                # each word of a text with one left neighbour, drawn by hash
                word = pair & ((1 << _WIDTH) - 1)
                order = np.lexsort((mix(pair.astype(np.uint64) + doc.astype(np.uint64)), word, doc))
                lead = np.append(True, (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
                drawn = order[lead[: len(order)]]
                kind = np.concatenate([label[doc[once]], label[doc[drawn]] + 2]).astype(np.int32)
                first = np.concatenate([before[once], np.zeros(len(drawn), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(first), pa.array(np.concatenate([pair[once], pair[drawn]]))],
                    names=["kind", "first", "pair"],
                )

    return run


class Counts:
    """One class: kept pairs with their discounted counts, totals of left words, and word probabilities."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, left_n: np.ndarray, before: np.ndarray, vocabulary: Vocabulary, discount: float):
        discounted = lambda x: np.maximum(x - discount, 0)
        self.pairs, self.n, self.left_n, self.discount = pairs, n, left_n, discount
        kept = discounted(n)
        used = np.bincount(pairs >> _WIDTH, kept, minlength=len(left_n)) if len(pairs) else np.zeros(len(left_n))
        self.rest = (left_n - used).astype(np.float32)
        total = max(before.sum(), 1.0)
        by_stem = discounted(np.bincount(vocabulary.stem_of, before, minlength=len(vocabulary.shared)))
        stem = (by_stem + (total - by_stem.sum()) * vocabulary.shared) / total
        base = discounted(before)
        self.word = (base + (total - base.sum()) * stem[vocabulary.stem_of] * vocabulary.within) / total
        self.word = self.word.astype(np.float32)

    def log(self, pair: np.ndarray) -> np.ndarray:
        left, right = pair >> _WIDTH, pair & ((1 << _WIDTH) - 1)
        n = self.left_n[left]
        found = np.zeros(len(pair))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            found = np.where(self.pairs[at] == pair, np.maximum(self.n[at] - self.discount, 0), 0.0)
        word = self.word[right].astype(float)
        p = np.where(n > 0, (found + self.rest[left] * word) / np.maximum(n, 1), word)
        return np.log(np.maximum(p, 1e-300))


class Model:
    def __init__(self, vocabulary: Vocabulary, ordinary: Counts, toxic: Counts):
        self.vocabulary, self.ordinary, self.toxic = vocabulary, ordinary, toxic
        self.curve = np.zeros(FEATURES)

    def features(self, texts) -> np.ndarray:
        ptr, ids = self.vocabulary.numbers(texts)
        pair = _pairs(ptr, ids, len(self.vocabulary.stem_of))
        ratio = self.toxic.log(pair) - self.ordinary.log(pair)
        n = np.diff(ptr)
        mean, excess = np.zeros(len(n)), np.zeros(len(n))
        for i in np.flatnonzero(n).tolist():
            own = ratio[ptr[i] : ptr[i + 1]]
            own = own - np.median(own)
            mean[i], excess[i] = own.mean(), np.maximum(own - CLEAR, 0).mean()
        root = np.sqrt(n)
        return np.stack([mean, mean * root, excess, excess * root, np.ones(len(n))], 1)

    def scores(self, texts) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.curve)


def corpus_words(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``stem`` and ``n`` of every word of all texts."""
    counts = docs.select("text").mapInArrow(_word_counts, "word long, stem long, n long")
    return counts.groupBy("word").agg(F.max("stem").alias("stem"), F.sum("n").alias("n"))


def _class_tables(rows: DataFrame, label: int, size: int):
    """Arrays of one class out of ``kind, pair, n``: the pairs, totals by left word, left neighbours by word.

    Pairs counted once are in the totals alone: no discount leaves anything of them.
    """
    own = rows.where(F.col("kind") == label).select("pair", "n")
    drawn = rows.where(F.col("kind") == label + 2).select("pair")
    left, right = F.shiftright("pair", _WIDTH), F.col("pair").bitwiseAND((1 << _WIDTH) - 1)
    left_n, before = np.zeros(size + 1, np.float32), np.zeros(size)
    for frame, key, value, into in (
        (own, left, F.sum("n"), left_n),
        (drawn, right, F.count("*"), before),
    ):
        got = frame.groupBy(key.alias("k")).agg(value.alias("v")).toArrow()  # at most a row per word
        into[got["k"].to_numpy()] = got["v"].to_numpy()
    kept = own.where("n > 1").toArrow().sort_by("pair")
    return kept["pair"].to_numpy(), kept["n"].to_numpy().astype(np.float32), left_n, before


def _vocabulary(counted: DataFrame, taught: DataFrame) -> Vocabulary:
    """The words of the texts ``taught`` and their stems, with their counts in the corpus (``word, stem, n``)."""
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    own = durable(corpus_words(taught).select("word", "stem"))
    words = counted.join(own.select("word"), "word", "left_semi").toArrow()
    stemmed = counted.groupBy("stem").agg(F.sum("n").alias("n"))
    stems = stemmed.join(own.select("stem").distinct(), "stem", "left_semi").toArrow()
    hashes = lambda x: x.to_numpy().view(np.uint64)
    counts = lambda x: x["n"].to_numpy().astype(float)
    return Vocabulary(hashes(words["word"]), hashes(words["stem"]), counts(words), hashes(stems["stem"]), counts(stems), total)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model | float:
    """The models of both classes, or the share of label 1 if only one label is there (0.5 if none)."""
    _, totals = labelled_sample(labels, label, fit_rows)
    if len(totals) < 2:
        return float(next(iter(totals), 0.5))
    # classes of unequal size would differ in what they have not seen
    chosen, _ = labelled_sample(labels, label, min(fit_rows, *totals.values()))  # bounded, so it may be broadcast
    held = unit("doc_id", F.lit("held")) < HELD
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = rows.mapInArrow(_with_marks, "doc_id long, text string, label int, mark1 long, mark2 long")
    for mark in ("mark1", "mark2"):  # near copies would count as many texts
        firsts = rows.groupBy("label", mark).agg(F.min("doc_id").alias("doc_id"))
        rows = rows.join(firsts.select("label", "doc_id"), ["label", "doc_id"], "left_semi")
    rows = durable(rows)
    vocabulary = _vocabulary(durable(corpus_words(docs)), rows.where(~held))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pairs = durable(
        rows.where(~held)
        .mapInArrow(_class_pairs(shared), "kind int, first long, pair long")
        .distinct()
        .groupBy("kind", "pair")
        .agg(F.count("*").alias("n"))
    )
    tables = [_class_tables(pairs, c, len(vocabulary.stem_of)) for c in (0, 1)]
    models = [Model(vocabulary, *[Counts(*t, vocabulary, d) for t in tables]) for d in DISCOUNTS]
    spread = docs.sparkSession.sparkContext.broadcast(models)
    points = rows.where(held).mapInArrow(_points(spread), "doc_id long, label int, x array<double>").toPandas()
    points = points.sort_values("doc_id")
    y = points["label"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return totals[1] / (totals[0] + totals[1])
    x = np.stack(points["x"].to_list()).reshape(len(y), len(models), FEATURES)
    best = None
    for i, model in enumerate(models):
        model.curve, loss = logistic(x[:, i], y, totals)
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def _points(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.concatenate([m.features(part.column("text")) for m in shared.value], 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "x"],
                )

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                score = np.full(part.num_rows, model) if isinstance(model, float) else model.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` of every row of ``docs(doc_id, text, ...)``; higher is more likely toxic.

    A null, empty or wordless text has a ratio of 0 and gets the score of the curve there.
    Repeated rows are scored each; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def op2_toxicity_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = fit(docs, table(spark, folder, "labels").where(~held_out))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity_kneser_ney": op2_toxicity_kneser_ney}
SQL: dict[str, str] = {}
