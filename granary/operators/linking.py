"""Joins that link documents (J1-J8, J11-J21, AR-1, U1-U6, W8, Z14, Z15): duplicates, references, merging, first-seen.

Every lookup is an equi-join on exploded identifiers; title similarity compares only titles that share a blocking token
set (their least frequent tokens), never all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import jaccard, normalised, tokens


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with the same key, the first by order; rows without a part of the key are all kept."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    best = df.where(known).groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*").unionByName(df.where(~known))


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def attach(left: DataFrame, right: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """left with right's value, or the default."""
    return left.join(right.select(key, F.col(value).alias("_v")), key, "left").withColumn(value, F.coalesce("_v", default)).drop("_v")


def expand_ids(df: DataFrame, id_col: str, ids: str, meta: DataFrame, meta_id: str, fields: Sequence[str]) -> DataFrame:
    """id and the array of (id, fields...) for an array of ids, in order; unknown ids have null fields."""
    rows = df.select(F.col(id_col).alias("_id"), F.posexplode(ids).alias("_pos", "_ref"))
    known = meta.select(F.col(meta_id).alias("_ref"), *fields)
    found = rows.join(known, "_ref", "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_pos", F.col("_ref").alias("id"), *fields))).alias("_l"))
    drop_pos = F.transform("_l", lambda e: F.struct(e["id"].alias("id"), *(e[f].alias(f) for f in fields)))
    return df.select(F.col(id_col).alias("_id")).join(found, "_id", "left").select(F.col("_id").alias(id_col), F.coalesce(drop_pos, F.array()).alias(ids))


def duplicate_cascade(new: DataFrame, existing: DataFrame, keys: Sequence[Sequence[str]], id_col: str = "id") -> DataFrame:
    """new with duplicate_of: the smallest existing id that agrees on the first of the keys that finds any."""
    out, found = new, []
    for i, key in enumerate(keys):
        known = existing.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).groupBy(*key).agg(F.min(id_col).alias(f"_d{i}"))
        out = out.join(known, list(key), "left")
        found.append(f"_d{i}")
    return out.withColumn("duplicate_of", F.coalesce(*found)).drop(*found).select(*new.columns, "duplicate_of")


def title_classes(df: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """id, class_id, tokens: the smallest id with the same set of tokens, which is sorted; titles without tokens are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens(F.col(title_col)))).alias("tokens")).where("size(tokens) > 0")
    first = rows.groupBy("tokens").agg(F.min("id").alias("class_id"))
    return rows.join(first, "tokens").select("id", "class_id", "tokens")


def similar_classes(classes: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b, similarity: pairs (a < b) of classes (class_id, tokens) whose sets have at least this Jaccard similarity.

    Prefix filtering: with tokens ordered from rare to frequent, similar sets share a token among their first
    size - ceil(least * size) + 1, so only those are joined, as narrow rows of sets of like size; no pair is lost. A
    frequent token is one key of that join, which adaptive execution splits.
    """
    n = F.size("tokens")
    each = classes.select("class_id", n.alias("n"), F.explode("tokens").alias("w"))
    df = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(df, "w").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    keep = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    keys = ranked.select("class_id", "n", F.explode(F.slice("o", F.lit(1), keep)).alias("e")).select("class_id", "n", F.col("e.w").alias("w"))
    a, b = keys.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "w"), keys.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "w")
    met = a.join(b, "w").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)).select("a", "b").distinct()
    sets = classes.select("class_id", "tokens")
    pairs = met.join(sets.select(F.col("class_id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("tokens").alias("tb")), "b")
    return pairs.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def similar_titles(df: DataFrame, id_col: str, title_col: str, least: float = 0.8) -> DataFrame:
    """id, class_id, links: of each row its class of equal token sets, and how many other rows have a similar title.

    Pairs are only made between classes, so copies cost nothing further.
    """
    rows = title_classes(df, id_col, title_col)
    classes = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"), F.first("tokens").alias("tokens"))
    pairs = similar_classes(classes, least).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("class_id").alias("b"), F.col("members").alias("more")), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("more").alias("more"))
    counts = classes.join(near, "class_id", "left").select("class_id", (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return rows.select("id", "class_id").join(counts, "class_id").select("id", "class_id", "links")


def shared_identifiers(df: DataFrame, id_col: str, identifiers: str) -> DataFrame:
    """left_id, right_id, kind: pairs that share a pmid, else a doi, else a url (J7, J8); identifiers is the struct of text.identifiers.

    A pair that shares several is made by the best of them alone, so pairs are not shuffled.
    For identifiers that few rows share; identifier_links tells the same in one row an id and identifier, however many share it.
    """
    rows = _identifiers(df, id_col, identifiers).distinct()
    common = rows.groupBy("rank", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank", "value")
    held = rows.join(common, ["rank", "value"]).groupBy("id").agg(F.collect_list(F.struct("rank", "value")).alias("every"))  # a row's own
    each = held.select("id", "every", F.explode("every").alias("e"))
    left, right = each.select(F.col("id").alias("left_id"), F.col("every").alias("_l"), "e"), each.select(F.col("id").alias("right_id"), F.col("every").alias("_r"), "e")
    pairs = left.join(right, "e").where("left_id <> right_id").where(F.array_min(F.array_intersect("_l", "_r")) == F.col("e"))
    return pairs.select("left_id", "right_id", _kind(F.col("e.rank")).alias("kind"))


def identifier_links(df: DataFrame, id_col: str, identifiers: str) -> DataFrame:
    """id, kind, value, class_id, links: of each id and identifier that others share, the class (its smallest id) and how many others.

    No pair is made: identifiers are counted before they are shuffled, and a crowded one costs its rows once. Two ids are linked if they
    are of one class of any kind.
    """
    rows = _identifiers(df, id_col, identifiers).distinct()
    classes = rows.groupBy("rank", "value").agg(F.min("id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links")).where("links > 0")
    return rows.join(classes, ["rank", "value"]).select("id", _kind(F.col("rank")).alias("kind"), "value", "class_id", "links")


#: Kinds of identifiers, best first.
KINDS = ("pmids", "dois", "urls")


def _identifiers(df: DataFrame, id_col: str, identifiers: str) -> DataFrame:
    """id, rank, value: each identifier of a row once, with the place of its kind."""

    def ranked(i: int) -> Column:
        return F.transform(F.col(f"{identifiers}.{KINDS[i]}"), lambda v: F.struct(F.lit(i).alias("rank"), v.alias("value")))

    each = F.concat(*map(ranked, range(len(KINDS))))
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(each)).alias("e")).select("id", "e.rank", "e.value")


def _kind(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k[:-1]) for k in KINDS)), rank + 1)


def named_in(texts: DataFrame, text_id: str, text: str, titles: DataFrame, title_id: str, title: str) -> DataFrame:
    """text_id, title_id: which texts have which titles, of three words at least, as whole words.

    Titles meet the texts that have their first three words in a row, by an equi-join of narrow rows; only those are compared.
    """
    whole = texts.select(F.col(text_id).alias("text_id"), normalised(F.col(text)).alias("t"))
    named = titles.select(F.col(title_id).alias("title_id"), normalised(F.col(title)).alias("n")).withColumn("w", F.split("n", " ")).where("size(w) > 2")
    words = whole.select("text_id", F.split("t", " ").alias("w")).where("size(w) > 2")
    runs = F.arrays_zip(*(F.slice("w", F.lit(i + 1), F.size("w") - 2).alias(f"w{i}") for i in range(3)))  # no lambda reads the whole text's array
    grams = F.transform(runs, lambda r: F.concat_ws(" ", r["w0"], r["w1"], r["w2"]))
    rows = words.select("text_id", F.explode(F.array_distinct(grams)).alias("gram"))
    met = rows.join(named.select("title_id", F.array_join(F.slice("w", 1, 3), " ").alias("gram")), "gram").select("text_id", "title_id").distinct()
    pairs = met.join(named.select("title_id", "n"), "title_id").join(whole, "text_id")
    return pairs.where(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "n", F.lit(" ")))).select("text_id", "title_id")


def overlap(df: DataFrame, id_col: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """id, total, hits, ratio: how many of the ids are in the known set."""
    rows = df.select(F.col(id_col).alias("id"), F.explode_outer(F.array_distinct(ids)).alias("ref"))
    marked = rows.join(known.select(F.col(known_id).alias("ref"), F.lit(1).alias("hit")).distinct(), "ref", "left")
    return marked.groupBy("id").agg(F.count("ref").alias("total"), F.count("hit").alias("hits")).withColumn("ratio", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0))


def not_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in known; null keys stay."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def merge_positions(a: Column, b: Column, fields: Sequence[str]) -> Column:
    """Two arrays of structs zipped by position, each field from a, else from b."""
    return F.zip_with(a, b, lambda x, y: F.struct(*(F.coalesce(F.when(x[f] != "", x[f]), y[f]).alias(f) for f in fields)))


def merge_duplicates(df: DataFrame, key: str, order: str, greatest: Sequence[str] = (), longest: Sequence[str] = (), united: Sequence[str] = (), summed: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """One row per key: maxima, longest texts, sorted unions of arrays, sums, and the first row's values (AR-1, U5)."""
    aggs = [F.max(c).alias(c) for c in greatest]
    aggs += [F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col(order))).alias(c) for c in longest]
    aggs += [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in summed]
    aggs += [F.min_by(c, order).alias(c) for c in first]
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("merged"), *aggs)
    for c in united:  # a row an element, so that only distinct ones meet in a group's row
        each = df.select(F.col(key).alias("_key"), F.explode(c).alias("_e")).distinct().groupBy("_key").agg(F.array_sort(F.collect_list("_e")).alias(c))
        out = out.join(each, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    return out.select(key, "merged", *greatest, *longest, *united, *summed, *first)
