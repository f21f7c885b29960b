"""Country groups: membership dimension and the operators over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_membership(countries: DataFrame) -> DataFrame:
    """country -> groups[]  =>  (group_name, country), every country also its own group.

    Groups overlap freely; empty group lists are fine.
    """
    selves = countries.select(F.col("country").alias("group_name"), "country")
    grouped = countries.select(F.explode("groups").alias("group_name"), "country")
    return selves.unionByName(grouped).distinct()


def group_members(membership: DataFrame) -> DataFrame:
    """group -> sorted member list and its size."""
    return membership.groupBy("group_name").agg(
        F.sort_array(F.collect_set("country")).alias("members"),
        F.countDistinct("country").cast("int").alias("n_members"),
    )


def group_catalogue(membership: DataFrame) -> DataFrame:
    """Groups with more than one member, members joined by ", " (F21, A20, A21)."""
    return (
        group_members(membership)
        .where(F.col("n_members") > 1)
        .select("group_name", "n_members", F.array_join("members", ", ").alias("members"))
    )


def rest_of_sample(membership: DataFrame, group_name: str) -> DataFrame:
    """Covered countries outside a group: n_countries - group size."""
    countries = membership.select("country").distinct()
    inside = membership.where(F.col("group_name") == group_name).select("country")
    return countries.join(inside, "country", "left_anti")


def valid_counterparts(membership: DataFrame, reporter: str) -> DataFrame:
    """Groups that share no member with ``reporter`` (M3: overlap exclusion, U3, U4).

    An anti join of all groups against the groups touching the reporter's
    members; no pairs are formed.
    """
    reporter_members = membership.where(F.col("group_name") == reporter).select("country")
    touching = membership.join(reporter_members, "country", "left_semi").select("group_name").distinct()
    return membership.select("group_name").distinct().join(touching, "group_name", "left_anti")


def members_of(groups: dict[str, tuple[str, ...]], names) -> tuple[str, ...]:
    """Resolve names to member countries; an unknown name stands for itself.

    Duplicates are kept, as the reference flattens lists without a set.
    """
    if isinstance(names, str):
        names = [names]
    out: list[str] = []
    for n in names:
        out.extend(groups.get(n, (n,)))
    return tuple(out)


def random_counterparts(membership: DataFrame, reporter: str, n: int = 5, seed: int = 0) -> DataFrame:
    """Up to ``n`` random groups that do not overlap the reporter.

    The reference draws a fresh random choice; ours is ordered by a hash of
    ``seed`` and name, so it is repeatable whatever the partitions. The limit
    is the feature: a sample of n choices.
    """
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("group_name")))
    return valid_counterparts(membership, reporter).orderBy(order, "group_name").limit(n)
