"""New names for objects, as native string expressions.

``{match|replace}`` chains edit a name; anything else is a whole-name template
whose wildcards come from the name patterns.  A caller may also pass a function
from a Column to a Column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, functions as F

from treecensus.functions.patterns import java_regex, quote
from treecensus.options import OptionError

_WILD = {"*": "(.*)", "?": "(.)"}


def _spans(text: str) -> list[tuple[str, str | None]]:
    """Top-level pieces of a pattern: (outside text, None) or (before, after) of a token."""
    pieces, level, start, bar = [], 0, 0, -1
    for i, c in enumerate(text):
        if c == "{":
            if level == 0:
                if i > start:
                    pieces.append((text[start:i], None))
                start, bar = i + 1, -1
            level += 1
        elif c == "}" and level:
            level -= 1
            if level == 0:
                if bar < 0:
                    pieces.append((text[start - 1:i + 1], None))
                else:
                    pieces.append((text[start:bar], text[bar + 1:i]))
                start = i + 1
        elif c == "|" and level == 1 and bar < 0:
            bar = i
    if level:
        raise OptionError(f"unbalanced braces in {text!r}")
    if start < len(text):
        pieces.append((text[start:], None))
    return pieces


def _replacement(text: str, groups: int) -> str:
    """Java replacement text; a group the pattern lacks contributes nothing."""
    out, used = [], 0
    for escaped, plain in re.findall(r"\\(.)|(.)", text, flags=re.S):
        if plain in _WILD and plain:
            used += 1
            ref = used
        elif escaped.isdigit():
            ref = int(escaped)
        else:
            out.append("\\" + (escaped or plain))
            continue
        if 1 <= ref <= groups:
            out.append(f"${ref}")
    return "".join(out)


def substitution(pattern: str) -> Callable[[Column], Column]:
    """A chain of tokens, applied left to right to all matches."""
    steps = []
    for match, replace in _spans(pattern):
        if replace is None:
            raise OptionError(f"{match!r} is not a {{match|replace}} token")
        if not match:
            raise OptionError("a token needs text to match")
        regex = "".join(_WILD.get(c, c) for c in match)
        try:
            groups = re.compile(regex).groups
        except re.error as bad:
            raise OptionError(f"not a regular expression: {match!r} ({bad})") from bad
        steps.append(("(?dU)" + java_regex(regex), _replacement(replace, groups)))

    def apply(name: Column) -> Column:
        for regex, replace in steps:
            name = F.regexp_replace(name, regex, replace)
        return name

    return apply


def template(pattern: str, name_patterns: Sequence[str] = ()) -> Callable[[Column], Column]:
    """A whole new name; null where no pattern can fill its wildcards."""
    pieces = re.split(r"([*?])", pattern)
    needed = len(pieces) // 2
    if not needed:
        return lambda name: F.lit(pattern)
    wild = [p for p in name_patterns if re.search(r"[*?]", p)]
    if not wild:
        raise OptionError(f"{pattern!r} has wildcards but no name pattern does")

    def apply(name: Column) -> Column:
        choices = []
        for glob in wild:
            parts = re.split(r"([*?])", glob)
            if len(parts) // 2 < needed:
                continue
            regex = "(?d)^" + "".join(_WILD.get(p) or quote(p) for p in parts) + "$"
            filled = [F.regexp_extract(name, regex, i // 2 + 1) if i % 2 else F.lit(p)
                      for i, p in enumerate(pieces)]
            choices.append(F.when(name.rlike(regex), F.concat(*filled)))
        return F.coalesce(*choices) if choices else F.lit(None).cast("string")

    return apply


def renamer(pattern, name_patterns: Sequence[str] = ()) -> Callable[[Column], Column]:
    """Choose the style by the shape of the pattern."""
    if callable(pattern):
        return pattern
    if not pattern:
        raise OptionError("the new name is empty")
    if pattern.startswith("{"):
        return substitution(pattern)
    try:
        tokens = any(replace is not None for _, replace in _spans(pattern))
    except OptionError:
        tokens = False
    if tokens:
        raise OptionError(f"nothing may stand around the tokens of {pattern!r}")
    return template(pattern, name_patterns)


def suffix_text(stamp: datetime, pattern: str = "_restored_{datetime}", snapshot: int | str = "") -> str:
    """Suffix of a name that would clash; one stamp serves a whole run."""
    date, time = stamp.strftime("%Y-%m-%d"), stamp.strftime("%H-%M-%S")
    words = {"date": date, "time": time, "datetime": f"{date}_{time}", "snapshot": str(snapshot)}
    return re.sub(r"\{(\w+)\}", lambda m: words.get(m[1], m[0]), pattern)


def with_suffix(name: Column, suffix: str) -> Column:
    """Insert the suffix in front of the extension."""
    extension = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.concat(F.left(name, F.length(name) - F.length(extension)), F.lit(suffix), extension)
