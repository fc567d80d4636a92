"""Access-control entries as arrays of structs, edited with higher-order functions.

An entry is ``struct<type, trustee, flags array<string>, rights array<string>>``
with type ``Allow`` or ``Deny``, flag letters plus ``INHERITED``, and rights as
single letters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from treecensus import constants as C

ACE = "struct<type:string,trustee:string,flags:array<string>,rights:array<string>>"
ACL = f"struct<control:array<string>,posix_special:array<string>,aces:array<{ACE}>>"
Edit = Callable[[Column], Column]


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def new_ace(kind: str, flags: Sequence[str], who: str, rights: Sequence[str]) -> Column:
    """An entry of literals, folded into a constant when the plan is made."""
    return F.struct(F.lit(kind).alias("type"), F.lit(who).alias("trustee"), _strings(flags).alias("flags"),
                    _strings([r for r in C.RIGHTS if r in rights]).alias("rights"))


def ordered(rights: Column) -> Column:
    """Rights in canonical letter order."""
    return F.filter(_strings(C.RIGHTS), lambda letter: F.array_contains(rights, letter))


def is_inherited(ace: Column) -> Column:
    return F.array_contains(ace["flags"], C.INHERITED)


def explicit(ace: Column) -> Column:
    return ace.withField("flags", F.array_except(ace["flags"], _strings([C.INHERITED])))


def matches(kind: str, who: str) -> Callable[[Column], Column]:
    return lambda ace: (ace["type"] == kind) & (ace["trustee"] == who)


def _first(aces: Column, hit) -> Column:
    """Zero-based place of the first match, -1 without one."""
    return (F.array_position(F.transform(aces, lambda a: F.coalesce(hit(a), F.lit(False))), True) - 1).cast("int")


def ace_text(ace: Column, group=None) -> Column:
    """``Type:flags:trustee:rights``; a group is marked with the letter g."""
    flags = F.array_join(F.array_except(ace["flags"], _strings([C.INHERITED])), "")
    if group is not None:
        flags = F.concat(flags, F.when(group(ace["trustee"]), F.lit("g")).otherwise(F.lit("")))
    return F.concat_ws(":", ace["type"], flags, ace["trustee"], F.array_join(ace["rights"], ""))


def trustee_texts(aces: Column, group=None) -> Column:
    return F.transform(aces, lambda a: ace_text(a, group))


def allows(aces: Column, right: str, who: str) -> Column:
    """Some Allow entry gives the trustee the right."""
    return F.exists(aces, lambda a: matches(C.ALLOW, who)(a) & F.array_contains(a["rights"], right))


def remove(kind: str, who: str) -> Edit:
    return lambda aces: F.filter(aces, lambda a: ~matches(kind, who)(a))


def add(kind: str, flags: Sequence[str], who: str, rights: Sequence[str]) -> Edit:
    """Merge into the first entry of this type and trustee, or append one."""
    def edit(aces: Column) -> Column:
        place = _first(aces, matches(kind, who))
        merged = F.transform(aces, lambda a, i: F.when(
            i == place,
            a.withField("flags", F.array_union(a["flags"], _strings(flags))).withField(
                "rights", ordered(F.array_union(a["rights"], _strings(rights))))).otherwise(a))
        return F.when(place >= 0, merged).otherwise(
            F.concat(aces, F.array(new_ace(kind, flags, who, rights))))
    return edit


def replace(kind: str, flags: Sequence[str], who: str, rights: Sequence[str]) -> Edit:
    """New flags and rights in place; the mark of an inherited entry stays."""
    def swap(a: Column) -> Column:
        kept = F.array_intersect(a["flags"], _strings([C.INHERITED]))
        return a.withField("flags", F.array_union(_strings(flags), kept)).withField(
            "rights", new_ace(kind, flags, who, rights)["rights"])
    return lambda aces: F.transform(
        aces, lambda a: F.when(matches(kind, who)(a), swap(a)).otherwise(a))


def replace_new(old: tuple[str, str], new: tuple[str, Sequence[str], str, Sequence[str]]) -> Edit:
    """The first match becomes the new entry, further matches go."""
    def edit(aces: Column) -> Column:
        hit = matches(*old)
        place = _first(aces, hit)
        swapped = F.transform(aces, lambda a, i: F.when(i == place, new_ace(*new)).otherwise(a))
        return F.filter(swapped, lambda a, i: (i <= place) | ~hit(a))
    return edit


def add_rights(kind: str, who: str, rights: Sequence[str]) -> Edit:
    return lambda aces: F.transform(aces, lambda a: F.when(
        matches(kind, who)(a),
        a.withField("rights", ordered(F.array_union(a["rights"], _strings(rights))))).otherwise(a))


def remove_rights(kind: str, who: str, rights: Sequence[str]) -> Edit:
    """Take rights away; an entry left with none is dropped."""
    def edit(aces: Column) -> Column:
        cut = F.transform(aces, lambda a: F.when(
            matches(kind, who)(a),
            a.withField("rights", F.array_except(a["rights"], _strings(rights)))).otherwise(a))
        return F.filter(cut, lambda a: (F.size(a["rights"]) > 0) | ~matches(kind, who)(a))
    return edit


def clone(source: Column | str, target: Column | str, sync: bool = False) -> Edit:
    """Copy the entries of one trustee to another, type by type.

    A type the target already has is left alone, or takes the source's rights
    when syncing.  ``origin`` may name the list that copies are taken from.
    """
    def edit(aces: Column, origin: Column | None = None) -> Column:
        origin = aces if origin is None else origin
        giver, taker = (F.lit(t) if isinstance(t, str) else t for t in (source, target))

        def of(who: Column, kind: Column, inside: Column = aces) -> Column:
            return F.filter(inside, lambda x: (x["trustee"] == who) & (x["type"] == kind))

        given = F.filter(origin, lambda a: (a["trustee"] == giver)
                         & (F.size(of(taker, a["type"])) == 0))
        copies = F.transform(given, lambda a: a.withField("trustee", taker))
        kept = aces
        if sync:
            kept = F.transform(aces, lambda a: F.when(
                (a["trustee"] == taker) & (F.size(of(giver, a["type"], origin)) > 0),
                a.withField("rights", F.try_element_at(of(giver, a["type"], origin), F.lit(1))["rights"]),
            ).otherwise(a))
        return F.when(taker.isNull() | (giver == taker), aces).otherwise(F.concat(kept, copies))
    return edit


def canonical(aces: Column) -> Column:
    """Explicit before inherited, Deny before Allow in each, otherwise stable."""
    keyed = F.transform(aces, lambda a, i: F.struct(
        is_inherited(a).cast("int").alias("late"),
        (a["type"] != C.DENY).cast("int").alias("kind"),
        i.alias("place"), a.alias("ace")))
    return F.transform(F.array_sort(keyed), lambda k: k["ace"])


def chain(*edits: Edit) -> Edit:
    """Several edits in the order given, then canonical order."""
    def edit(aces: Column) -> Column:
        for step in edits:
            aces = step(aces)
        return canonical(aces)
    return edit


def from_mode(mode: str, directory: Column, owner: str | None = None,
              group: str | None = None) -> Column:
    """ACL of an octal mode; the set-group bit only counts on directories."""
    bits = int(mode, 8)
    aces = []
    for shift, who in ((6, owner or C.OWNER_AT), (3, group or C.GROUP_AT), (0, C.EVERYONE_AT)):
        given = "".join(text for bit, text in C.MODE_RIGHTS.items() if bits >> shift & bit)
        if given:
            aces.append(new_ace(C.ALLOW, [], who, list(given)))
    special = [F.when(F.lit(bool(bits & 0o4000)), F.lit("SET_UID")),
               F.when(F.lit(bool(bits & 0o2000)) & directory, F.lit("SET_GID")),
               F.when(F.lit(bool(bits & 0o1000)), F.lit("STICKY_BIT"))]
    return F.struct(
        _strings([]).alias("control"),
        F.filter(F.array(*special), lambda x: x.isNotNull()).alias("posix_special"),
        F.array(*aces).cast(f"array<{ACE}>").alias("aces"))


def disable_inheritance(acl: Column, remove_inherited: bool = False) -> Column:
    """Stop inheriting: entries become explicit, or inherited ones are deleted."""
    aces = (F.filter(acl["aces"], lambda a: ~is_inherited(a)) if remove_inherited
            else F.transform(acl["aces"], explicit))
    return acl.withField("aces", aces).withField(
        "control", F.array_union(acl["control"], _strings([C.PROTECTED])))


def mark_inherited(aces: Column) -> Column:
    return F.transform(aces, lambda a: a.withField(
        "flags", F.array_union(a["flags"], _strings([C.INHERITED]))))
