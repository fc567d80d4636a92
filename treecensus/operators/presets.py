"""Named searches for everyday questions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from treecensus.functions import paths
from treecensus.functions.patterns import GLOB, SharedNames
from treecensus.operators.reports import categories
from treecensus.operators.search import Search, predicate

# --- fixed values: name patterns, ages and sizes of the named searches ---
PRESETS = {
    "stale": Search(type="file", ages={"access_time": (730, None), "modification_time": (730, None)}),
    "cold": Search(type="file", ages={"access_time": (90, None)}),
    "cold_large": Search(type="file", ages={"access_time": (365, None)}, larger_than="100MB"),
    "retention": Search(type="file", ages={"creation_time": (2555, None)}),
    "privacy_retention": Search(type="file", older_than=1095),
    "temporary": Search(type="file", names=("*.tmp", "*.temp", "*.bak", "~*"), older_than=30),
    "old_logs": Search(type="file", names=("*.log", "*.log.*"), older_than=90),
    "core_dumps": Search(type="file", names=("core.*", "*.core"), pattern_mode=GLOB, older_than=30),
    "compressible": Search(type="file", names=("*.log", "*.txt", "*.csv", "*.json"), larger_than="100MB"),
    "ransomware": Search(type="file", names=(
        "*.encrypted", "*.locked", "*.crypto", "*.crypt", "*.enc", "*.crypted")),
    "ransom_notes": Search(type="file", names=(
        "*README*", "*DECRYPT*", "*RECOVER*", "*INSTRUCTION*", "*HOW_TO*"),
        ages={"modification_time": (None, 7)}),
    "recent_executables": Search(type="file", names=(
        "*.exe", "*.dll", "*.bat", "*.ps1", "*.sh", "*.py", "*.js"), ages={"creation_time": (None, 7)}),
    "media": Search(type="file", names=(
        "*.mov", "*.mp4", "*.mxf", "*.r3d", "*.ari", "*.braw", "*.prores"), larger_than="1GB"),
    "archive_candidates": Search(type="file", larger_than="100MB", ages={
        "access_time": (180, None), "modification_time": (180, None)}),
    "render_cache": Search(type="file", names=(
        "*.tmp", "*cache*", "*preview*", "*.peak", "*.pek", "*.pkf"), older_than=30),
    "proxies": Search(type="file", names=("*proxy*", "*_lowres*", "*_small*")),
    "originals": Search(type="file", names=("*.r3d", "*.braw", "*.ari"), larger_than="1GB"),
}


def named_searches(entries: DataFrame, as_of, presets=PRESETS) -> DataFrame:
    """(path, category) for every preset an object matches, in one scan.

    The globs of all presets are one pass over a name, and only over names of
    objects that some preset with names would take for all its other tests.
    """
    names = SharedNames(paths.basename(F.col("path")))
    searches = {name: replace(opts, as_of=as_of) for name, opts in presets.items()}
    tests = {name: predicate(entries, opts, names.matches) for name, opts in searches.items()}
    needed = F.lit(False)
    for opts in searches.values():
        if opts.names or opts.names_not or opts.names_all:
            needed = needed | predicate(entries, replace(opts, names=(), names_not=(), names_all=()))
    return categories(entries.withColumns(names.columns(needed)), tests)
