"""Display text for owners and groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def filled(text: Column) -> Column:
    """Null for an empty string."""
    return F.when(F.length(text) > 0, text)


def owner_key(details: Column, plain: Column) -> Column:
    """The id an object is matched by: the one in the details wins."""
    return F.coalesce(filled(details["auth_id"]), filled(plain))


def raw_id(details: Column, fallback: Column) -> Column:
    """Identity without a lookup, e.g. ``UID:1001``."""
    kind, value = details["id_type"], details["id_value"]
    shown = F.coalesce(value, F.lit(""))
    return (F.when(kind == "NFS_UID", F.concat(F.lit("UID:"), shown))
            .when(kind == "NFS_GID", F.concat(F.lit("GID:"), shown))
            .when(kind == "SMB_SID", F.concat(F.lit("SID:"), shown))
            .when(F.length(value) > 0, F.concat(F.lit("auth_id:"), value))
            .when(F.length(fallback) > 0, F.concat(F.lit("auth_id:"), fallback))
            .otherwise(F.lit("Unknown")))


def owner_name(name: Column, domain: Column, uid: Column, gid: Column) -> Column:
    """Name with its POSIX number; ``Unknown`` when there is no identity."""
    def numbered(label: str, number: Column) -> Column:
        tag = F.concat(F.lit(label + " "), number.cast("string"))
        named = (F.length(name) > 0) & ~name.startswith("Unknown")
        return F.when(named, F.concat(name, F.lit(" ("), tag, F.lit(")"))).otherwise(tag)

    return (F.when((domain == "POSIX_USER") & uid.isNotNull(), numbered("UID", uid))
            .when((domain == "POSIX_GROUP") & gid.isNotNull(), numbered("GID", gid))
            .otherwise(F.coalesce(name, F.lit("Unknown"))))
