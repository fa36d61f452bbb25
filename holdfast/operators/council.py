"""Votes, archives and accounting of replicated patterns (from the design documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Members of a council; their pairs and names come to the driver.
MOST_MEMBERS = 256


def members_of(votes: DataFrame) -> list[str]:
    """The different members of ``votes``, in order; more than MOST_MEMBERS are an error."""
    found = sorted(r[0] for r in votes.select("member").where("member is not null").distinct().limit(MOST_MEMBERS + 1).collect())
    if len(found) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members")
    return found


def decisions(votes: DataFrame) -> DataFrame:
    """(pattern_id, approving_groups, rejects, archived): two independent groups approve and none rejects. A
    member without group is one of its own."""
    group = F.coalesce("independence_group", "member")
    counted = votes.groupBy("pattern_id").agg(F.count_distinct(F.when(F.col("vote") == "approve", group)).alias("approving_groups"), F.count_if(F.col("vote") == "reject").alias("rejects"))
    return counted.withColumn("archived", (F.col("approving_groups") >= 2) & (F.col("rejects") == 0))


def independence(votes: DataFrame) -> DataFrame:
    """(a, b, patterns, independence): 1 less the mean cosine of two members' rationales on common patterns, a vote a member
    and pattern. Pairs are those of at most MOST_MEMBERS members; a rationale of zeros has no cosine and counts in none."""
    members_of(votes)
    norm = F.nullif(F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))
    v = votes.select("pattern_id", "member", F.col("embedding").cast("array<double>").alias("e")).withColumn("u", F.transform("e", lambda x: x / norm)).select("pattern_id", "member", "u")
    right = v.select("pattern_id", F.col("member").alias("b"), F.col("u").alias("w"))
    both = v.join(right, "pattern_id").where("member < b")
    cosine = F.aggregate(F.zip_with("u", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.groupBy(F.col("member").alias("a"), "b").agg(F.count("*").alias("patterns"), (1 - F.avg(cosine)).alias("independence"))


def groups(pairs: DataFrame, members: list[str], theta: float) -> dict[str, str]:
    """member -> group: pairs below ``theta`` are collapsed; of at most MOST_MEMBERS members."""
    root = {m: m for m in members}
    for r in sorted(pairs.where(F.col("independence") < theta).collect(), key=lambda r: (r["a"], r["b"])):
        low, high = sorted((root[r["a"]], root[r["b"]]))
        root = {m: low if g == high else g for m, g in root.items()}
    return root


def regrouped(votes: DataFrame, pairs: DataFrame, theta: float) -> DataFrame:
    """``votes`` with the groups that measured independence makes of their members, in place of the stated ones: members
    of pairs below ``theta`` count as one. Members without a common pattern keep a group of their own."""
    own = groups(pairs, members_of(votes), theta)
    names = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return votes.withColumn("independence_group", F.try_element_at(names, F.col("member")) if own else F.col("member"))


def calibration(votes: DataFrame, archive: DataFrame, least: float) -> DataFrame:
    """(member, approvals, rate, flagged): how many of a member's approved and re-tested patterns held again."""
    own = votes.where("vote = 'approve'").join(archive.select("pattern_id", "re_replicated"), "pattern_id")
    rate = F.avg(F.col("re_replicated").cast("double"))
    return own.groupBy("member").agg(F.count("*").alias("approvals"), rate.alias("rate")).withColumn("flagged", F.col("rate") < least)


def meta_validation(results: DataFrame) -> DataFrame:
    """Per protocol: re-replication rates after pass and after fail verdicts, and their difference."""
    rate = lambda v: F.avg(F.when(F.col("verdict") == v, F.col("re_replicated").cast("double")))
    return results.groupBy("protocol").agg(rate(True).alias("after_pass"), rate(False).alias("after_fail")).withColumn("discrimination", F.col("after_pass") - F.col("after_fail"))


def archive_status(archive: DataFrame, annotations: DataFrame) -> DataFrame:
    """Archive entries with their latest annotation; both tables are only appended to."""
    latest = annotations.groupBy("pattern_id").agg(F.max("annotated_at").alias("annotated_at"), F.max_by("re_replicated", "annotated_at").alias("re_replicated"))
    return archive.join(latest, "pattern_id", "left")


def cycle_log(cycles: DataFrame, budget: float, start: int, week: int = 7 * 86400) -> DataFrame:
    """Per week: cycles, proposals, archived, spend, and the running share of the budget."""
    at = F.floor((F.col("t") - start) / week)
    weekly = cycles.groupBy(at.alias("week")).agg(F.count("*").alias("cycles"), F.sum("proposals").alias("proposals"), F.count_if("archived").alias("archived"), F.sum("usd").alias("usd"))
    return weekly.withColumn("budget_share", F.sum("usd").over(Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)) / budget)  # a row per week


def clock(records: DataFrame, start: int, length: int, budget: float) -> DataFrame:
    """Per day: share of time and of budget used, patterns archived and re-replicated so far, projected total."""
    daily = records.groupBy(F.floor((F.col("t") - start) / 86400).alias("day")).agg(F.sum("usd").alias("usd"), F.count_if("archived").alias("a"), F.count_if("re_replicated").alias("r"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row per day
    out = daily.select("day", ((F.col("day") + 1) * 86400 / length).alias("time_share"), (F.sum("usd").over(upto) / budget).alias("budget_share"), F.sum("a").over(upto).alias("archived"), F.sum("r").over(upto).alias("re_replicated"))
    return out.withColumn("projected", F.col("archived") / F.col("time_share"))


def rereplication_due(archive: DataFrame, tests: DataFrame, now: int, age: int) -> DataFrame:
    """Entries archived at least ``age`` seconds ago without a test since."""
    old = archive.where(F.col("archived_at") <= now - age)
    fresh = tests.join(old.select("pattern_id", "archived_at"), "pattern_id").where(F.col("tested_at") > F.col("archived_at")).select("pattern_id").distinct()
    return old.join(fresh, "pattern_id", "left_anti")
