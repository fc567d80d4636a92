"""Names, equivalents and owner lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from treecensus import constants as C
from treecensus.functions import identities as I
from treecensus.operators.joins import lookup_join
from treecensus.operators.search import owner_column


def display_names(ids: DataFrame) -> DataFrame:
    """(auth_id, shown, domain) of an identity table."""
    return ids.select("auth_id", I.owner_name(F.col("name"), F.col("domain"), F.col("uid"), F.col("gid"))
                      .alias("shown"), "domain")


def resolve_names(entries: DataFrame, ids: DataFrame, resolve: bool = True,
                  who: Sequence[str] = ("owner", "group")) -> DataFrame:
    """Add ``owner_name`` and ``group_name``; raw ids without any join when not resolving."""
    if not resolve:
        return entries.withColumns({
            f"{w}_name": I.raw_id(F.col(f"{w}_details"), F.col(w)) for w in who})
    names = display_names(ids).select("auth_id", "shown")
    for w in who:
        entries = (lookup_join(entries, names, owner_column(entries, w), "auth_id")
                   .withColumn(f"{w}_name", F.coalesce("shown", F.lit("Unknown"))).drop("shown"))
    return entries


def domain_rank(domain: Column) -> Column:
    rank = F.lit(3)
    for name, place in C.DOMAIN_RANK.items():
        rank = F.when(domain == name, F.lit(place)).otherwise(rank)
    return rank


def ranked_equivalents(ids: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Named equivalents of every identity as (auth_id, rank, position, name, domain)."""
    named = ids.where(F.length("name") > 0).select(
        F.col("auth_id").alias("other_id"), "name", "domain")
    return (lookup_join(equivalents, named, F.col("other_id"), "other_id", "inner", spread="auth_id")
            .select("auth_id", domain_rank(F.col("domain")).alias("rank"), "position", "name", "domain"))


def best_names(ids: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Own name, else the best named equivalent; the original id and domain stay."""
    best = (ranked_equivalents(ids, equivalents).groupBy("auth_id")
            .agg(F.min(F.struct("rank", "position", "name", "domain")).alias("best")))
    own = F.length("name") > 0
    return ids.join(best, "auth_id", "left").select(
        "auth_id", "domain",
        F.when(own, F.col("name")).otherwise(F.col("best.name")).alias("name"),
        F.when(~F.coalesce(own, F.lit(False)), F.col("best.domain")).alias("display_domain"))


def expand(ids: DataFrame, equivalents: DataFrame) -> DataFrame:
    """One hop of equivalents as (auth_id, member): itself, equivalents, NFS and SMB id."""
    own = ids.select("auth_id", F.explode(F.array("auth_id", "nfs_id", "smb_id")).alias("member"))
    others = equivalents.select("auth_id", F.col("other_id").alias("member"))
    return own.unionByName(others).where("member IS NOT NULL").distinct()


def resolve_owners(ids: DataFrame, owners: Sequence[str], kind: str = "auto") -> DataFrame:
    """Auth ids of owners typed by a user; an owner nobody has, or that can't be one, is left out.

    Besides the kinds by name, ``auto`` knows numbers (uid), ``S-1-...`` (SID), ``DOMAIN\\user`` and
    ``user@domain``; the last two are accounts of the directory, by the whole text or the bare name.
    """
    def number(column: str, typed: str) -> Column:
        value = typed.removeprefix(f"{column}:")
        return F.col(column) == int(value) if value.isdecimal() and len(value) < 19 else F.lit(False)

    def directory(typed: str) -> Column:
        bare = typed.rpartition("\\")[2] if "\\" in typed else typed.partition("@")[0]
        return (F.col("name") == typed) | ((F.col("domain") == "ACTIVE_DIRECTORY") & (F.col("name") == bare))

    tests = {
        "uid": lambda o: number("uid", o),
        "gid": lambda o: number("gid", o),
        "sid": lambda o: F.col("sid") == o.removeprefix("sid:") if "sid" in ids.columns else F.lit(False),
        "domain": directory,
        "ad": lambda o: (F.col("domain") == "ACTIVE_DIRECTORY") & (F.col("name") == o),
        "local": lambda o: (F.col("domain") == "LOCAL") & (F.col("name") == o),
        "auth_id": lambda o: F.col("auth_id") == o.removeprefix("auth_id:"),
        "name": lambda o: F.col("name") == o,
    }

    def test(owner: str) -> Column:
        chosen = kind
        if kind == "auto":
            head = owner.partition(":")[0].lower()
            chosen = head if head in ("uid", "gid", "sid", "ad", "local", "auth_id") else (
                "uid" if owner.isdecimal() else "sid" if owner.upper().startswith("S-1-")
                else "domain" if "\\" in owner or "@" in owner else "name")
            if chosen in ("ad", "local"):
                owner = owner.partition(":")[2]
        return tests[chosen](owner)

    hit = F.lit(False)
    for owner in owners:
        hit = hit | F.coalesce(test(owner), F.lit(False))
    return ids.where(hit).select("auth_id").distinct()


def expand_owners(found: DataFrame, ids: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Union of the members of several owners, without repeats."""
    members = lookup_join(expand(ids, equivalents), found, F.col("auth_id"), "auth_id", "semi", spread="member")
    return members.select(F.col("member").alias("auth_id")).distinct()
