"""Expressions over absolute paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean(path: Column) -> Column:
    """Path without trailing slashes."""
    return F.rtrim(path, F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(clean(path), "/", -1)


def parent(path: Column) -> Column:
    """Containing directory of an absolute path; ``/`` for a top-level object.

    ``greatest`` puts ``/`` in place of an empty text and evaluates its argument once.
    """
    bare = clean(path)
    return F.greatest(F.left(bare, F.length(bare) - F.length(basename(path)) - 1), F.lit("/"))


def depth(path: Column) -> Column:
    """Number of components, so a top-level object has depth 1."""
    bare = clean(path)
    return F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))


def root_text(root: str | None) -> str:
    """Search root as text: ``/`` or a path without trailing slash."""
    return (root or "/").rstrip("/") or "/"


def root_depth(root: str) -> int:
    return 0 if root == "/" else root.count("/")


def below(path: Column, root: str) -> Column:
    """Strictly below the root. A prefix test, so it reaches the scan."""
    return path.startswith("/" if root == "/" else root + "/") & (clean(path) != root)


def prefix(path: Column, n: Column) -> Column:
    """The first ``n`` components of a path."""
    return F.call_function("substring_index", path, F.lit("/"), n + 1)


def _prefixes(bare: Column, first: int, last: Column) -> Column:
    return F.when(
        last >= first,
        F.transform(F.sequence(F.lit(first), last), lambda i: prefix(bare, i)),
    ).otherwise(F.array().cast("array<string>"))


def ancestors(path: Column, root: str = "/") -> Column:
    """Directories strictly between the root and the object, top first."""
    return _prefixes(clean(path), root_depth(root) + 1, depth(path) - 1)


def ancestors_or_self(path: Column, root: str = "/") -> Column:
    """Same, with the object itself at the end; ``/`` has none."""
    return _prefixes(clean(path), root_depth(root) + 1, depth(path))


def fold_dots(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def link_target(path: Column, target: Column) -> Column:
    """Symlink target as an absolute path."""
    return F.when(
        target.isNotNull(),
        fold_dots(F.when(target.startswith("/"), target)
                  .otherwise(F.concat(parent(path), F.lit("/"), target))),
    )


def join_path(directory: Column, name: Column) -> Column:
    return F.concat(clean(directory), F.lit("/"), name)
