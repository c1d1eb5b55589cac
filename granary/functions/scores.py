"""Score functions as Columns (M-1 to M-20, D-7): completeness, recency, blends, routing, priorities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: Sequence[tuple[float, float]], below: float = 0.0) -> Column:
    """The second number of the first step whose first number is under value; steps from high to low."""
    out = F.lit(float(below))
    for least, points in reversed(steps):
        out = F.when(value > least, F.lit(float(points))).otherwise(out)
    return out


def points(parts: Sequence[tuple[Column, float]], base: float = 0.0, cap: float = 1.0) -> Column:
    """base and the points of each condition that holds, at most cap."""
    total = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), F.lit(p)).otherwise(F.lit(0.0)) for c, p in parts], F.lit(float(base)))
    return F.least(F.lit(float(cap)), total)


#: Ages in days, and the score of anything younger.
AGES = ((30, 1.0), (90, 0.9), (180, 0.8), (365, 0.7), (730, 0.6), (1095, 0.5), (1825, 0.4))
OLDEST, UNDATED = 0.3, 0.5


def recency(date: Column, content_type: Column, as_of: Column) -> Column:
    """The age ladder; articles gain 0.1, documentation older than a year loses a fifth; no date gives 0.5 (D-7)."""
    days = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(date.cast("timestamp"))) / 86400.0
    score = F.lit(OLDEST)
    for most, value in reversed(AGES):
        score = F.when(days < most, F.lit(value)).otherwise(score)
    score = F.when((content_type == "documentation") & (days > 365), score * 0.8).when(content_type == "article", F.least(score + 0.1, F.lit(1.0))).otherwise(score)
    return F.when(date.isNull(), F.lit(UNDATED)).otherwise(score)


def weighted(parts: dict[str, Column], content_type: Column, weights: dict[str, dict[str, float]]) -> Column:
    """The weighted sum of component scores with the type's weights, a quarter each without any, within 0 and 1 (M-4)."""

    def total(of: dict[str, float]) -> Column:
        return reduce(lambda a, b: a + b, [c * of.get(name, 0.25) for name, c in parts.items()])

    out = total({})
    for kind, of in weights.items():
        out = F.when(content_type == kind, total(of)).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


#: The share of the quality score in the final score, by type.
QUALITY_SHARE = {"article": 0.3, "video": 0.4, "repository": 0.35, "discussion": 0.25, "documentation": 0.5}


def final_score(combined: Column, quality: Column, content_type: Column) -> Column:
    """combined (1 - w) + quality w (M-7)."""
    w = F.lit(0.3)
    for kind, share in QUALITY_SHARE.items():
        w = F.when(content_type == kind, F.lit(share)).otherwise(w)
    return combined * (1 - w) + quality * w


def blend(raw: Column, model: Column, other: Column) -> Column:
    """The model's probability and another's, the model weighing 0.7, 0.65 or 0.6 by how sure it was before calibration (M-8)."""
    w = F.when((raw > 0.98) | (raw < 0.02), F.lit(0.7)).when((raw > 0.8) | (raw < 0.2), F.lit(0.65)).otherwise(F.lit(0.6))
    return F.when(other.isNull(), model).otherwise(model * w + other * (1 - w))


def adjusted(p: Column, type_weight: Column, boosts: Sequence[tuple[Column, float]]) -> Column:
    """p times the type's weight; each boost that applies multiplies, at most to 1 (M-6)."""
    out = p * type_weight
    for applies, factor in boosts:
        out = F.when(F.coalesce(applies, F.lit(False)), F.least(F.lit(1.0), out * factor)).otherwise(out)
    return out


def route(score: Column, approve: float = 0.7, priority: float = 0.5, reject: float = 0.3) -> Column:
    """approved, review_high, review_low or rejected; each bound belongs to the better tier (M-9, M-10)."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= approve, "approved").when(s >= priority, "review_high").when(s >= reject, "review_low").otherwise("rejected")


def priority(tier: Column, score: Column) -> Column:
    """7, 5 or 3 by tier, and up to 3 for the score, at most 10 (M-11)."""
    base = F.when(tier == "high", 7).when(tier == "low", 3).otherwise(5)
    return F.least(F.lit(10), base + F.least(F.lit(3), F.floor(F.coalesce(score, F.lit(0.0)) * 3).cast("int")))


def article_priority(score: Column, low: Column | None = None) -> Column:
    """9, 7, 5 or 3 from 0.9, 0.8 and 0.7 on; for low-priority rows four less, one at least (M-12)."""
    out = F.when(score >= 0.9, 9).when(score >= 0.8, 7).when(score >= 0.7, 5).otherwise(3)
    return out if low is None else F.when(low, F.greatest(F.lit(1), out - 4)).otherwise(out)


def approves(mode: str, model: Column, other: Column, final: Column, threshold: float = 0.7) -> Column:
    """Whether the scores approve by themselves: combined, either or both (M-10)."""
    return {"combined": final >= threshold, "either": (model >= threshold) | (other >= threshold), "both": (model >= threshold) & (other >= threshold)}[mode]


def review_tier(score: Column, known_author: Column, approve: float, priority_: float, reject: float) -> Column:
    """route(), but low-tier rows by unknown authors are reviewed first (M-10)."""
    tier = route(score, approve, priority_, reject)
    return F.when((tier == "review_low") & ~F.coalesce(known_author, F.lit(True)), "review_high").otherwise(tier)


def trending(views: Column, bookmarks: Column) -> Column:
    """views + 2 bookmarks (M-19)."""
    return F.coalesce(views, F.lit(0)) + 2 * F.coalesce(bookmarks, F.lit(0))


def rates(views: Column, replies: Column, likes: Column) -> Column:
    """reply_rate and like_rate over the views, of which there is one at least (M-13)."""
    v = F.greatest(views, F.lit(1))
    return F.struct((replies / v).alias("reply_rate"), (likes / v).alias("like_rate"))


def capped(parts: Sequence[tuple[Column, float, float]], places: int = 2) -> Column:
    """The sum of least(value / cap, 1) times weight over (value, cap, weight), rounded (M-14 to M-18)."""
    return F.round(reduce(lambda a, b: a + b, [F.least(F.lit(1.0), F.coalesce(x, F.lit(0)) / cap) * w for x, cap, w in parts]), places)


#: Roles by rank.
ROLES = {"explorer": 1, "learner": 2, "researcher": 3, "implementer": 4, "contributor": 5, "reviewer": 6, "admin": 7}


def has_role(role: Column, least: str) -> Column:
    """The role ranks at least as high (M-20)."""
    rank = F.lit(0)
    for name, n in ROLES.items():
        rank = F.when(role == name, F.lit(n)).otherwise(rank)
    return rank >= ROLES[least]


def completeness(content_type: Column, fields: dict[str, Column]) -> Column:
    """Points for the parts that each type should have (M-1); fields by name, missing ones count as absent."""
    none = F.lit(None)

    def there(name: str) -> Column:
        return F.coalesce(fields.get(name, none).cast("string"), F.lit("")) != ""

    def longer(name: str, n: float) -> Column:
        return F.length(F.coalesce(fields.get(name, none).cast("string"), F.lit(""))) > n

    def more(name: str, n: float) -> Column:
        return F.coalesce(fields.get(name, F.lit(0)), F.lit(0)) > n

    by_type = {
        "article": [(there("title"), 0.15), (longer("abstract", 100), 0.25), (more("n_authors", 0), 0.15), (there("doi"), 0.15), (there("journal"), 0.1), (more("n_keywords", 0), 0.1), (there("date"), 0.1)],
        "video": [(there("title"), 0.2), (there("abstract"), 0.15), (there("transcript"), 0.3), (more("duration", 60), 0.15), (there("channel"), 0.1), (there("thumbnail"), 0.1)],
        "repository": [(there("title"), 0.15), (there("abstract"), 0.15), (longer("content", 100), 0.25), (there("language"), 0.1), (there("license"), 0.15), (more("n_topics", 0), 0.1), (there("date"), 0.1)],
        "discussion": [(there("title"), 0.2), (there("answer"), 0.4), (more("n_answers", 0), 0.2), (more("n_tags", 0), 0.1), (there("solved"), 0.1)],
        "documentation": [(there("title"), 0.2), (longer("content", 200), 0.3), (there("version"), 0.15), (there("section"), 0.15), (there("official"), 0.2)],
    }
    out = F.lit(0.0)
    for kind, parts in by_type.items():
        out = F.when(content_type == kind, points(parts)).otherwise(out)
    return out
