"""Evaluation, calibration, features and query learning.

Term statistics are one explode and one groupBy; what comes to the driver is a bounded list of candidate queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.session import durable

#: Words that a plan holds as a set; of more, runs of all words are made.
LITERALS = 8192


def confusion(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1, fpr, fnr; 0 where a ratio has no base."""
    y, p = label.cast("boolean"), predicted.cast("boolean")
    one = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))

    def ratio(a: str, *base: str) -> Column:
        total = reduce(lambda x, z: x + z, [F.col(b) for b in base])
        return F.when(total > 0, F.col(a) / total).otherwise(0.0)

    one = one.withColumn("precision", ratio("tp", "tp", "fp")).withColumn("recall", ratio("tp", "tp", "fn"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return one.withColumn("f1", f1).withColumn("fpr", ratio("fp", "fp", "tn")).withColumn("fnr", ratio("fn", "fn", "tp"))


def score_spread(df: DataFrame, by: str, score: str) -> DataFrame:
    """by, least, upper median and largest score.

    Values are counted by class and sorted by range of class and value; a range's running count starts from its class's rows in
    those before, so no task holds a whole class.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(by, score).agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts.repartitionByRange(by, score).withColumn("part", F.spark_partition_id()))
    of_class = Window.partitionBy(by)
    parts = counts.groupBy(by, "part").agg(F.sum("n").alias("rows"))  # one row a class and range
    parts = parts.select(F.col(by).alias("_by"), F.col("part").alias("_part"), (F.sum("rows").over(of_class.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(of_class).alias("all"))
    placed = counts.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("part") == F.col("_part")))
    until = F.sum("n").over(Window.partitionBy("part", by).orderBy(score)) + F.col("before")
    middle = F.when(F.col("until") > F.floor(F.col("all") / 2), F.col(score))
    return placed.withColumn("until", until).groupBy(by).agg(F.min(score).alias("least"), F.min(middle).alias("median"), F.max(score).alias("most"))


def thresholds(df: DataFrame, score: str, label: str, steps: int = 20) -> DataFrame:
    """threshold, precision, recall, npv on a grid of thresholds, in one pass."""
    cut = F.explode(F.array(*(F.lit(round(i / steps, 6)) for i in range(1, steps))))
    counts = df.groupBy(F.floor(F.col(score) * steps).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("good"))
    rows = counts.select("bin", "n", "good", cut.alias("threshold"))
    above = F.col("bin") >= F.round(F.col("threshold") * steps)
    agg = rows.groupBy("threshold").agg(F.sum(F.when(above, F.col("good")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("n")).otherwise(0)).alias("p"), F.sum("good").alias("y"), F.sum("n").alias("n"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(None).cast("double"))
    return agg.select("threshold", safe(F.col("tp"), F.col("p")).alias("precision"), safe(F.col("tp"), F.col("y")).alias("recall"), safe(F.col("n") - F.col("p") - F.col("y") + F.col("tp"), F.col("n") - F.col("p")).alias("npv"))


def grams(text: Column, most: int = 3, words: Sequence[str] | None = None) -> Column:
    """Distinct word n-grams of 1 to `most` words (L12); with `words` only those made of these."""

    def bound(x: Column, f: Callable[[Column], Column]) -> Column:
        # bound once by a one-element transform, so that a text isn't split again for each gram
        return F.get(F.transform(F.array(x), f), 0)

    def of(t: Column, runs: list[Column]) -> Column:
        if len(runs) == most:
            return F.array_distinct(F.array_compact(F.concat(*runs)))
        # a run is the one a word shorter and the next word; null where that is missing or none of `words`
        return bound(F.zip_with(runs[-1], F.slice(t, len(runs) + 1, F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda longer: of(t, [*runs, longer]))

    each = tokens(text)
    if words is not None:
        each = F.transform(each, lambda w: F.when(w.isin(list(words)), w))
    return bound(each, lambda t: of(t, [t]))


def term_statistics(df: DataFrame, text: str, label: str, most: int = 1, least_docs: int = 3, words: Sequence[str] | None = None) -> DataFrame:
    """term, pos, neg, coverage (share of positives), specificity (share of positives among those with it) (A43, L11-L13); with `words` of terms made of these."""
    sizes = df.agg(F.sum(label).alias("all_pos"))
    rows = df.select(F.col(label).alias("y"), F.explode(grams(F.col(text), most, words)).alias("term"))
    rows = rows.groupBy("term").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    rows = rows.join(F.broadcast(sizes))  # one row
    return rows.select("term", "pos", (F.col("n") - F.col("pos")).alias("neg"), (F.col("pos") / F.col("all_pos")).alias("coverage"), (F.col("pos") / F.col("n")).alias("specificity"))


def covering_words(stats: DataFrame, coverage: float) -> list[str] | None:
    """The words of at least this coverage, for `words`; None (no bound) if they are more than a plan should hold.

    No term is in more positives than a word of it, so terms of this coverage are made of these words alone.
    """
    found = stats.where(F.col("coverage") >= coverage).select("term").limit(LITERALS + 1).collect()
    return [r["term"] for r in found] if len(found) <= LITERALS else None


def brand_terms(stats: DataFrame, coverage: float = 0.2, specificity: float = 0.95, most: int = 50) -> DataFrame:
    """Terms over both bounds by coverage times squared specificity."""
    rows = stats.where((F.col("coverage") >= coverage) & (F.col("specificity") >= specificity))
    return rows.withColumn("score", F.col("coverage") * F.col("specificity") * F.col("specificity")).orderBy(F.desc("score"), "term").limit(most)


def without_parts(terms: Sequence[tuple[str, float]]) -> list[str]:
    """A bounded list, best first, without terms that are part of a better one or contain it."""
    kept: list[str] = []
    for term, _ in sorted(terms, key=lambda t: (-t[1], t[0])):
        if not any(term in k or k in term for k in kept):
            kept.append(term)
    return kept


def matches_query(text: Column, query: Sequence[Sequence[str]]) -> Column:
    """All groups have a term that the text contains: (a OR b) AND (c) as [[a, b], [c]]."""
    low = F.lower(F.coalesce(text, F.lit("")))
    groups = [reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in g]) for g in query]
    return reduce(lambda a, b: a & b, groups)


def greedy_cover(df: DataFrame, text: str, queries: Sequence[Sequence[Sequence[str]]], target: float = 0.9, most: int = 15) -> list[tuple[int, int, float]]:
    """(query, newly covered, recall so far): the query that covers most of what is left, until target or most.

    One scan turns each document into the list of the queries that match it; query_learning.cover counts in rounds.
    """
    from granary.operators.query_learning import cover

    hits = F.array_compact(F.array(*(F.when(matches_query(F.col(text), q), F.lit(i)) for i, q in enumerate(queries))))
    return [(r["query"], r["new_matches"], r["recall"]) for r in cover(df.select(hits.alias("queries")), target, most)]


#: Fixed patterns of study texts.
PATTERNS = {"has_statistics": r"(?i)p\s*[<=>]\s*0?\.\d+|95\s*%\s*ci|odds ratio|hazard ratio", "has_cohort": r"(?i)\bcohort", "has_network": r"(?i)\bnetwork\b|multi-?(site|center|database)", "has_method": r"(?i)\bmethods?\b", "has_code": r"(?i)github\.com|open[- ]source", "has_number": r"\d"}


def features(text: Column, authors: Column | None = None) -> list[Column]:
    """Numeric features of a text: lengths, pattern flags, author count (L2-L4)."""
    t = F.coalesce(text, F.lit(""))
    out = [F.length(t).cast("double").alias("n_chars"), F.size(tokens(t)).cast("double").alias("n_tokens"), F.size(F.array_distinct(tokens(t))).cast("double").alias("n_distinct")]
    out += [t.rlike(p).cast("double").alias(name) for name, p in PATTERNS.items()]
    if authors is not None:
        out.append(F.size(authors).cast("double").alias("n_authors"))
    return out


def fold(key: Column, folds: int = 5, seed: int = 42) -> Column:
    """A row's fold by a seeded hash of its key: the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def forest(rows: DataFrame, inputs: Sequence[str], label: str, text: str | None = None, terms: int = 100, trees: int = 50, depth: int = 8, seed: int = 42):
    """Fitted pipeline: features and TF-IDF of the `terms` commonest words to a random forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover, VectorAssembler

    stages, columns = [], list(inputs)
    if text:
        stages += [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}_]+"), StopWordsRemover(inputCol="_w", outputCol="_v"), CountVectorizer(inputCol="_v", outputCol="_c", vocabSize=terms, minDF=2), IDF(inputCol="_c", outputCol="_tfidf")]
        columns.append("_tfidf")
    stages += [VectorAssembler(inputCols=columns, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def out_of_fold(rows: DataFrame, key: str, inputs: Sequence[str], label: str, folds: int = 5, **options) -> DataFrame:
    """key, label, probability of each row by a forest that didn't see its fold."""
    from pyspark.ml.functions import vector_to_array

    rows = rows.withColumn("_fold", fold(F.col(key), folds))
    parts = []
    for k in range(folds):
        model = forest(rows.where(F.col("_fold") != k), inputs, label, **options)
        parts.append(model.transform(rows.where(F.col("_fold") == k)).select(key, label, vector_to_array("probability")[1].alias("probability")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def calibrator(scored: DataFrame, label: str):
    """Isotonic model from out-of-fold probabilities (L6, Z33); its predictions are already within 0 and 1."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol="probability", labelCol=label, predictionCol="calibrated").fit(scored.withColumn(label, F.col(label).cast("double")))
