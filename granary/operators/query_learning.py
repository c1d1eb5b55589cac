"""Learning search queries from labelled documents (L14-L17, L20, L21, J20, W7, Z38-Z44): terms, contexts, candidates, greedy cover.

What a term is found in is decided once, by an automaton over all terms that runs inside the tasks (substrings of the
lower-case text); afterwards documents are short arrays of numbers. Co-occurrence is a sparse product of these arrays,
pruned by what a pair can still reach. The cover goes in rounds of one aggregate over the distinct sets of matching
queries; only gains, one number a query, come to the driver. Lists of terms and candidates are bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.learning import covering_words, matches_query, term_statistics
from granary.session import durable

#: The least share of joint occurrences, documents with the phrase and in a group, contexts of a phrase.
SHARE, GAP_SHARE, LEAST_DOCS, GROUP_DOCS, CONTEXTS = 0.30, 0.15, 3, 5, 3
#: Recall aimed at and queries at most; a gap of fewer documents is left alone.
TARGET, MOST_QUERIES, LEAST_GAP = 0.90, 15, 10
#: Least coverage of a term of the gap; how many of the best make queries.
GAP_COVERAGE, GAP_TERMS = 0.08, 30
#: Terms whose parts one task makes; a term of a title has some sixty.
BLOCK = 20_000


@dataclass(frozen=True)
class Candidate:
    """A query: every group has a term that the text contains."""

    name: str
    strategy: str
    groups: tuple[tuple[str, ...], ...]

    @property
    def terms(self) -> list[str]:
        return [t for g in self.groups for t in g]

    @property
    def query(self) -> str:
        parts = [" OR ".join(f'"{t}"' for t in g) for g in self.groups]
        return " AND ".join(f"({p})" if " OR " in p and len(parts) > 1 else p for p in parts)


@dataclass(frozen=True)
class Term:
    term: str
    coverage: float
    specificity: float

    @property
    def is_phrase(self) -> bool:
        return " " in self.term


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, term in shared.value:
            automaton.add_word(term, number)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({n for _, n in automaton.iter(t)}) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["key", "found"])

    return run


def _found(rows: DataFrame, numbered: list[tuple[int, str]]) -> DataFrame:
    schema = T.StructType([rows.schema["key"]]).add("found", T.ArrayType(T.IntegerType()))
    if not any(t for _, t in numbered):
        return rows.select("key", F.array().cast("array<int>").alias("found"))
    shared = rows.sparkSession.sparkContext.broadcast([(n, t) for n, t in numbered if t])
    return rows.mapInArrow(_finder(shared), schema)


def occurrences(docs: DataFrame, key: str, text: Column, terms: Sequence[str]) -> DataFrame:
    """key and found: the places in `terms`, a bounded list, of those that the lower-case text contains, rising."""
    first: dict[str, int] = {}
    for i, t in enumerate(terms):
        first.setdefault(t.lower(), i)
    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    return _found(rows, [(i, t) for t, i in first.items()])


def without_subsumed(terms: DataFrame) -> DataFrame:
    """terms (term, score), a row a term, without those that lie inside a longer one of a higher score, or of the same and smaller as text.

    What contains a kept term of higher rank is itself no bar: containment is transitive, so any better term that contains
    one is enough, and no order of rounds is needed. A term's parts of the lengths that terms have are rows; of each part the
    best term that it is part of is kept, by an aggregate that combines in the tasks, so a part of very many terms is no large group.
    """
    terms = durable(terms.select("term", "score").where(F.col("term") != ""))
    size, lengths = F.length("term"), sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())  # a number a length
    if not lengths:
        return terms
    rows = terms.repartition(-(-terms.count() // BLOCK), "term")
    rows = rows.select("term", "score", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n < size)).alias("n"))
    rows = rows.select("term", "score", "n", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("at"))
    best = rows.groupBy(F.substr("term", F.col("at"), F.col("n")).alias("part")).agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("term").alias("of"))).alias("best"))
    met = terms.join(best, F.col("term") == F.col("part"), "left")
    better = (-F.col("best.less") > F.col("score")) | ((-F.col("best.less") == F.col("score")) & (F.col("best.of") < F.col("term")))
    return met.where(~F.coalesce(better, F.lit(False))).select("term", "score")


def together(found: DataFrame, share: float = SHARE, least: int = LEAST_DOCS) -> DataFrame:
    """(a, n_a, b, both): how many rows with term a also have b, where that is at least `share` of n_a and n_a at least `least`.

    b can only reach it if it has share * n_a rows itself; other pairs are dropped before they are counted.
    """
    counts = F.broadcast(durable(found.select(F.explode("found").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))))  # one row a term
    each = found.select(F.explode("found").alias("a"), "found").join(counts.select(F.col("t").alias("a"), F.col("n").alias("n_a")), "a").where(F.col("n_a") >= least)
    pairs = each.select("a", "n_a", F.explode("found").alias("b")).where("a <> b").join(counts.select(F.col("t").alias("b"), F.col("n").alias("n_b")), "b")
    pairs = pairs.where(F.col("n_b") >= share * F.col("n_a") - 1e-9).groupBy("a", "n_a", "b").agg(F.count(F.lit(1)).alias("both"))
    return pairs.where(F.col("both") >= share * F.col("n_a") - 1e-9)


def _apart(a: Column, b: Column) -> Column:
    return ~(F.contains(a, b) | F.contains(b, a))


def context_terms(found: DataFrame, terms: Sequence[Term], stop: Sequence[str] = (), most: int = CONTEXTS, share: float = SHARE) -> DataFrame:
    """(term, contexts) of each term that has any: those that stand in at least `share` of its rows, best first, none inside another.

    A context's score is that share times its coverage times its specificity; ties go by place in `terms`.
    """
    spark = found.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, t.term, t.coverage * t.specificity, len(t.term) > 2 and t.term not in set(stop)) for i, t in enumerate(terms)], "n int, term string, weight double, may boolean"))
    pairs = together(found, share).join(known.select(F.col("n").alias("a"), F.col("term").alias("term")), "a")
    pairs = pairs.join(known.where("may").select(F.col("n").alias("b"), F.col("term").alias("context"), "weight"), "b")
    pairs = pairs.where(_apart(F.col("term"), F.col("context"))).withColumn("score", F.round(F.col("both") / F.col("n_a") * F.col("weight"), 12))
    ranked = pairs.groupBy("term").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "b", "context"))).alias("r"))  # at most all terms
    names = F.transform("r", lambda x: x["context"])
    picked = F.aggregate(names, F.array().cast("array<string>"), lambda acc, c: F.when((F.size(acc) < most) & ~F.exists(acc, lambda s: ~_apart(s, c)), F.concat(acc, F.array(c))).otherwise(acc))
    return ranked.select("term", picked.alias("contexts"))


def phrase_groups(terms: Sequence[Term], coverage: float = 0.05, most: int = 30) -> dict[str, list[str]]:
    """First word to phrases: each of the first `most` phrases takes in later ones that share a word of over three letters."""
    left = [t.term for t in terms if t.is_phrase and t.coverage >= coverage][:most]
    groups: dict[str, list[str]] = {}
    while left:
        head, *rest = left
        words = {w for w in head.split() if len(w) > 3}
        group = [head, *(t for t in rest if words & set(t.split()))]
        left = [t for t in rest if t not in group]
        if len(group) > 1:
            groups[head.split()[0]] = group
    return groups


def shared_contexts(found: DataFrame, groups: Sequence[Sequence[str]], terms: Sequence[Term], stop: Sequence[str] = ()) -> dict[int, list[str]]:
    """Of each group, by its place, the best terms in at least SHARE of the rows that have any of its terms."""
    place = {t.term: i for i, t in enumerate(terms)}
    owner = {place[t]: g for g, group in enumerate(groups) for t in group if t in place}
    if not owner:
        return {}
    lookup = F.create_map(*(F.lit(x) for kv in owner.items() for x in kv))
    hit = F.array_compact(F.array_distinct(F.transform("found", lambda t: F.try_element_at(lookup, t))))
    rows = found.select(F.explode(hit).alias("g"), "found")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.select("g", F.explode("found").alias("t")).groupBy("g", "t").agg(F.count(F.lit(1)).alias("both")).join(F.broadcast(sizes), "g")
    counts = counts.where((F.col("n") >= GROUP_DOCS) & (F.col("both") >= SHARE * F.col("n") - 1e-9))
    best: dict[int, list[tuple[float, int]]] = {}
    for g, t, both, n in counts.select("g", "t", "both", "n").collect():  # at most groups times terms
        term = terms[t].term
        if term not in stop and not any(term in m or m in term for m in groups[g]):
            best.setdefault(g, []).append((-both / n * terms[t].specificity, t))
    return {g: [terms[t].term for _, t in sorted(found_)[:3]] for g, found_ in best.items()}


def candidates(positives: DataFrame, negatives: DataFrame, key: str, text: str, brand: Sequence[Term], phrases: Sequence[Term], keywords: Sequence[Term] = (), subjects: Sequence[Term] = (), stop: Sequence[str] = (), shortest: int = 3) -> list[Candidate]:
    """Queries of all strategies, in order: brand, phrase with context, subject, combined groups, gap recovery."""
    out: list[Candidate] = []
    top = [t.term for t in brand if t.coverage >= 0.10 and t.specificity >= 0.80][:5]
    if top:
        out.append(Candidate("brand terms", "brand", (tuple(top),)))
    terms = list({t.term: t for t in [*phrases, *keywords, *subjects, *brand]}.values())
    place = {t.term: i for i, t in enumerate(terms)}
    found = durable(occurrences(positives, key, F.col(text), [t.term for t in terms]))
    contexts = {r["term"]: tuple(r["contexts"]) for r in context_terms(found, terms, stop).where(F.size("contexts") > 0).collect()}  # one row a term
    primary = [t for t in phrases if t.is_phrase and t.coverage >= 0.05 and t.specificity >= 0.50][:20]
    primary += [t for t in phrases if not t.is_phrase and t.coverage >= 0.10 and t.specificity >= 0.60][:10]
    out += [Candidate(f"phrase: {t.term}", "phrase_context", ((t.term,), contexts[t.term])) for t in primary if t.term in contexts]
    for t in [t for t in subjects if t.coverage >= 0.05][:15]:
        if t.term in contexts or t.specificity >= 0.80:
            out.append(Candidate(f"subject: {t.term}", "subject", ((t.term,), contexts[t.term]) if t.term in contexts else ((t.term,),)))
    groups = phrase_groups(phrases)
    shared = shared_contexts(found, list(groups.values()), terms, stop)
    out += [Candidate(f"combined: {name}", "combined", (tuple(group[:4]), tuple(shared[g]))) for g, (name, group) in enumerate(groups.items()) if shared.get(g)]
    names = [t.term for t in brand if t.term]
    gap = positives.where(~matches_query(F.col(text), [names])) if names else positives
    return out + gap_candidates(gap, negatives, key, text, stop, shortest)


def gap_candidates(gap: DataFrame, negatives: DataFrame, key: str, text: str, stop: Sequence[str] = (), shortest: int = 3, most: int = 15) -> list[Candidate]:
    """Queries for positives that no brand term finds, from terms of `shortest` letters and more that are common there and rare in the negatives."""
    n, others = gap.count(), negatives.count()
    if n < LEAST_GAP:
        return []
    good, bad = (d.select(F.col(text), F.lit(y).alias("_y")) for d, y in ((gap, 1), (negatives, 0)))
    words = covering_words(term_statistics(good, text, "_y", least_docs=1), GAP_COVERAGE)
    stats = term_statistics(good.unionByName(bad), text, "_y", most=3, least_docs=max(2, n * 5 // 100), words=words)
    specificity = 1 - F.col("neg") / max(others, 1)
    stats = stats.select("term", "coverage", specificity.alias("specificity")).where((F.col("coverage") >= GAP_COVERAGE) & (F.col("specificity") >= 0.50)).where(F.length("term") >= shortest).where(~F.col("term").isin(list(stop)) if stop else F.lit(True))
    best = stats.orderBy(F.round(F.col("coverage") * F.col("specificity"), 12).desc(), "term").limit(200).collect()
    terms = [Term(r["term"], r["coverage"], r["specificity"]) for r in best]
    found = durable(occurrences(gap, key, F.col(text), [t.term for t in terms]))
    joint = {}
    pairs = together(found, 0.0, 1).where((F.col("both") >= GAP_SHARE * n - 1e-9) & (F.col("a") < GAP_TERMS))
    for a, b in pairs.select("a", "b").collect():  # at most GAP_TERMS times terms
        joint.setdefault(a, set()).add(b)
    out = []
    for i, t in enumerate(terms[:GAP_TERMS]):
        context = [x.term for j, x in enumerate(terms) if j in joint.get(i, ()) and x.term not in t.term and t.term not in x.term][:CONTEXTS]
        if context and len(out) < most:
            out.append(Candidate(f"gap: {t.term}", "gap_recovery", ((t.term,), tuple(context))))
    return out


def matches(docs: DataFrame, key: str, text: str, queries: Sequence[Candidate]) -> DataFrame:
    """key and queries: the places of the queries that the text matches, rising."""
    terms = sorted({t.lower() for q in queries for t in q.terms})
    place = {t: i for i, t in enumerate(terms)}
    found = occurrences(docs, key, F.col(text), terms)

    def fits(q: Candidate) -> Column:
        return reduce(lambda a, b: a & b, [F.arrays_overlap("found", F.array(*(F.lit(place[t.lower()]) for t in g))) for g in q.groups])

    each = [F.when(fits(q), F.lit(i)) for i, q in enumerate(queries)]
    return found.select("key", F.array_compact(F.array(*each)).cast("array<int>").alias("queries") if each else F.array().cast("array<int>").alias("queries"))


def cover(matched: DataFrame, target: float = TARGET, most: int = MOST_QUERIES) -> list[dict]:
    """Rounds of the greedy cover (L20, W7): rank, query, total_matches, new_matches, covered, recall; ties go to the earlier query.

    Rows that match the same queries are one row with a count; a round is one aggregate of those not yet covered.
    """
    sets = durable(matched.groupBy("queries").agg(F.count(F.lit(1)).alias("n")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    left, covered, rounds, all_matches = sets.where(F.size("queries") > 0), 0, [], {}
    while len(rounds) < most and covered < target * total:
        gains = {r[0]: r[1] for r in left.select(F.explode("queries").alias("q"), "n").groupBy("q").agg(F.sum("n")).collect()}  # one row a query
        if not gains:
            break
        all_matches = all_matches or gains
        best = min(gains, key=lambda q: (-gains[q], q))
        covered += gains[best]
        rounds.append({"rank": len(rounds) + 1, "query": best, "total_matches": all_matches[best], "new_matches": gains[best], "covered": covered, "recall": round(covered / total, 9)})
        left = left.where(~F.array_contains("queries", best))
    return rounds


def watched(matched: DataFrame, chosen: Sequence[int], people: DataFrame, key: str, name: str, least: int = 10) -> DataFrame:
    """One row: total, by_queries, by_people, recall: rows that no chosen query matches count if one of their people has `least` rows."""
    names = people.select(F.col(key).alias("key"), F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    often = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("name")
    saved = names.join(often, "name", "left_semi").select("key", F.lit(1).alias("saved")).distinct()
    hit = F.arrays_overlap("queries", F.array(*map(F.lit, chosen))) if chosen else F.lit(False)
    one = matched.join(saved, "key", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("by_queries"), F.count_if(~hit & F.col("saved").isNotNull()).alias("by_people"))
    return one.withColumn("recall", F.when(F.col("total") > 0, (F.col("by_queries") + F.col("by_people")) / F.col("total")).otherwise(0.0))


def author_key(last: Column, initials: Column, name: Column) -> Column:
    """`last f`: last name and first initial in lower case, from `Last, First` where the last name is missing."""
    given = F.split(name, ", ", -1)
    family = F.coalesce(F.when(last != "", last), F.when(name.contains(", "), F.get(given, 0)))
    first = F.coalesce(F.when(initials != "", initials), F.when(name.contains(", "), F.get(given, 1)), F.lit(""))
    return F.lower(F.concat(family, F.lit(" "), F.substring(first, 1, 1)))


def report(docs: DataFrame, rounds: Sequence[dict], queries: Sequence[Candidate]) -> DataFrame:
    """The rounds as rows: rank, name, strategy, query, total_matches, new_matches, covered, recall."""
    rows = [(r["rank"], queries[r["query"]].name, queries[r["query"]].strategy, queries[r["query"]].query, r["total_matches"], r["new_matches"], r["covered"], r["recall"]) for r in rounds]
    return docs.sparkSession.createDataFrame(rows, "rank long, name string, strategy string, query string, total_matches long, new_matches long, covered long, recall double")


def top_terms(stats: DataFrame, most: int, least_coverage: float = 0.0, least_specificity: float = 0.0) -> list[Term]:
    """The best `most` terms by coverage times specificity (T11): what comes to the driver is a list of bounded length."""
    rows = stats.where((F.col("coverage") >= least_coverage) & (F.col("specificity") >= least_specificity))
    rows = rows.orderBy(F.round(F.col("coverage") * F.col("specificity"), 12).desc(), "term").limit(most)
    return [Term(r["term"], r["coverage"], r["specificity"]) for r in rows.collect()]


def best_terms(docs: DataFrame, text: str, label: str, words: DataFrame, most: int, longest: int = 3, shortest: int = 1) -> list[Term]:
    """top_terms of all terms of up to `longest` words and of `shortest` characters and more; `words` are the statistics of the single words.

    No term scores above its coverage, nor has more coverage than any word of it. So a term with a word of less coverage than
    the score of the last of the best `most` single words is behind all these, and such runs of words are never made.
    """
    fits = F.length("term") >= shortest
    alone = top_terms(words.where(fits), most)
    least = min(t.coverage * t.specificity for t in alone) - 1e-9 if len(alone) == most else 0.0
    return top_terms(term_statistics(docs, text, label, longest, words=covering_words(words, least)).where(fits), most)
