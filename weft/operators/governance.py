"""Provenance, access and visibility as joins and filters over tables.

Facts are DataFrames: resources (resource, mode, owner), members (account, group),
grants (resource, group) and agreements (account, resource). A decision is a column, so
that row-level policy is a filter that Catalyst pushes down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allowed(resources: DataFrame, account: str | None, members: DataFrame, grants: DataFrame, agreements: DataFrame) -> DataFrame:
    """resources with ``allowed``: open ones for all, registered ones for any account, restricted ones for the owner, a group with a grant, or an agreement; all else is denied."""
    groups = grants.join(members.where(F.col("account") == F.lit(account)), "group", "left_semi").select("resource").distinct().withColumn("by_group", F.lit(True))
    agreed = agreements.where(F.col("account") == F.lit(account)).select("resource").distinct().withColumn("by_agreement", F.lit(True))
    facts = resources.join(groups, "resource", "left").join(agreed, "resource", "left")
    known = F.lit(account is not None)
    own = F.coalesce(F.col("owner") == F.lit(account), F.lit(False)) | F.coalesce("by_group", F.lit(False)) | F.coalesce("by_agreement", F.lit(False))
    verdict = F.when(F.col("mode") == "open", True).when(F.col("mode") == "registered", known).when(F.col("mode") == "restricted", known & own).otherwise(False)
    return facts.withColumn("allowed", verdict).drop("by_group", "by_agreement")


def history(log: DataFrame, tag: str | None = None, actor=None, since=None, until=None) -> DataFrame:
    """Entries of log (seq, actor, activity, at) with that tag and actor, from since up to but without until, in order of time, then seq."""
    for given, test in ((tag, F.col("activity") == tag), (actor, F.col("actor") == actor), (since, F.col("at") >= F.lit(since)), (until, F.col("at") < F.lit(until))):
        if given is not None:
            log = log.where(test)
    return log.orderBy("at", "seq")


def visible(resources: DataFrame, log: DataFrame, deleted: str = "deleted", restored: str = "restored") -> DataFrame:
    """resources (resource) whose latest entry of these two kinds in log (resource, activity, at, seq) is not a deletion."""
    latest = log.where(F.col("activity").isin(deleted, restored)).groupBy("resource").agg(F.max_by("activity", F.struct("at", "seq")).alias("last"))
    return resources.join(latest.where(F.col("last") == deleted), "resource", "left_anti")


def numbered(log: DataFrame, by: str) -> DataFrame:
    """Each entry's number within its resource's history."""
    return log.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("at", "seq")).cast("long"))


def import_plan(bundle: DataFrame, present: DataFrame) -> DataFrame:
    """bundle (path, digest, rows) with ``action``: add what present (the same columns) lacks, keep what is equal there, refuse what differs."""
    have = present.groupBy("path").agg(F.max(F.struct("digest", "rows")).alias("have"))
    same = (F.col("have.digest") == F.col("digest")) & (F.col("have.rows") == F.col("rows"))
    action = F.when(F.col("have").isNull(), "add").when(same, "keep").otherwise("refuse")
    return bundle.join(have, "path", "left").select("path", "digest", "rows", action.alias("action"))


def import_new(rows: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """The rows whose import key no receipt has yet, so that a repeated import adds nothing."""
    return rows.join(receipts.select(key).distinct(), key, "left_anti")
