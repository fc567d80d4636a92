"""Name patterns: shell globs and regular expressions as native ``rlike`` tests.

Users write Python-style regular expressions; Spark evaluates Java ones.  The
driver translates the text once, the executors only ever run ``rlike``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from treecensus.constants import REGEX_CHARACTERS
from treecensus.options import OptionError

AUTO, REGEX, GLOB = "auto", "regex", "glob"
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_LITERAL = re.compile(r"[A-Za-z0-9_ ]|[^\x00-\x7f]")


def quote(text: str) -> str:
    """Text as a Java regex literal."""
    return "".join(c if _LITERAL.fullmatch(c) else f"\\x{{{ord(c):x}}}" for c in text)


def glob_body(glob: str) -> str:
    """Java regex for a shell glob, without anchors."""
    out, rest = [], glob
    while rest:
        bracket = re.match(r"\[(!?)(\]?[^\]]*)\]", rest, flags=re.S)
        if bracket and bracket[2]:
            out.append(_bracket(bracket[1] == "!", bracket[2]))
            rest = rest[bracket.end():]
            continue
        out.append({"*": ".*", "?": "."}.get(rest[0]) or quote(rest[0]))
        rest = rest[1:]
    return "".join(out)


def _bracket(negated: bool, body: str) -> str:
    parts, i = [], 0
    while i < len(body):
        if body[i + 1:i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:
                parts.append(f"{quote(body[i])}-{quote(body[i + 2])}")
            i += 3
        else:
            parts.append(quote(body[i]))
            i += 1
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def java_regex(pattern: str) -> str:
    """A Python-style pattern in Java's dialect."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c, pair = pattern[i], pattern[i:i + 2]
        if c == "\\":
            out.append("\\z" if pair == "\\Z" and not in_class else pair)
            i += 2
        elif in_class:
            # a bracket or && inside a class is an operator in Java only
            if pair == "&&":
                out.append(r"\&\&")
                i += 2
                continue
            out.append("\\[" if c == "[" else c)
            in_class = c != "]"
            i += 1
        elif c == "[":
            lead = re.match(r"\[\^?\]?", pattern[i:])[0]
            out.append(lead[:-1] + r"\]" if lead.endswith("]") else lead)
            in_class = True
            i += len(lead)
        elif pattern.startswith("(?P<", i):
            name = pattern[i + 4:pattern.index(">", i)]
            out.append(f"(?<{name.replace('_', 'U')}>")
            i += len(name) + 5
        elif pattern.startswith("(?P=", i):
            name = pattern[i + 4:pattern.index(")", i)]
            out.append(f"\\k<{name.replace('_', 'U')}>")
            i += len(name) + 5
        elif c == "{":
            count = _QUANTIFIER.match(pattern, i)
            if count and (count[1] or (count[2] and count[3])):
                out.append("{" + (count[1] or "0") + count[2] + count[3] + "}")
                i = count.end()
            else:
                out.append("\\{")
                i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def anchored(pattern: str) -> bool:
    return pattern[:1] == "^" or pattern[-1:] == "$"


def reads_as_regex(pattern: str, mode: str = AUTO) -> bool:
    """How a pattern is understood; auto prefers a regex when it can be one."""
    if mode != AUTO:
        return mode == REGEX
    return anchored(pattern) or (bool(REGEX_CHARACTERS & set(pattern)) and _compiles(pattern))


def ambiguous(pattern: str) -> bool:
    """Auto mode guessed: an unanchored pattern that is a regex and a glob."""
    return not anchored(pattern) and reads_as_regex(pattern)


def name_regex(pattern: str, mode: str = AUTO, case_sensitive: bool = False) -> str:
    """The Java regex a name is searched with.

    Flags: ``d`` only a line feed ends a line, ``U`` Unicode classes, ``iu``
    Unicode case folding.
    """
    fold = "" if case_sensitive else "iu"
    if reads_as_regex(pattern, mode):
        if not _compiles(pattern):
            raise OptionError(f"not a regular expression: {pattern!r}")
        return f"(?dU{fold}){java_regex(pattern)}"
    return f"(?s{fold})\\A(?:{glob_body(pattern)})\\z"


def match_name(name: Column, pattern: str, mode: str = AUTO, case_sensitive: bool = False) -> Column:
    """Does a base name match one pattern?"""
    return name.rlike(name_regex(pattern, mode, case_sensitive))


def match_any(name: Column, patterns, mode: str = AUTO, case_sensitive: bool = False) -> Column:
    hits = F.lit(False)
    for pattern in patterns:
        hits = hits | match_name(name, pattern, mode, case_sensitive)
    return hits


def _any_of(globs) -> str:
    """Java regex for any of some globs; those that begin with a star share it, so a name is gone through once for them."""
    bodies = [glob_body(g) for g in globs]
    open_, rest = [b[2:] for b in bodies if b.startswith(".*")], [b for b in bodies if not b.startswith(".*")]
    return "|".join([*rest, *([f".*(?:{'|'.join(open_)})"] if open_ else [])])


class SharedNames:
    """Tests of one name by many searches, whose globs are all looked for in one pass.

    ``matches`` stands for ``match_any``.  It refers to columns that ``columns`` makes afterwards, one for
    globs that mind case and one for those that do not.  A regular expression may count and name its own
    groups, so it stays a test of its own.
    """

    #: Put behind a name; a group catches it if the globs of a set match all that stands before.
    END = "\x01"

    def __init__(self, name: Column, prefix: str = "_names"):
        self.name, self.prefix = name, prefix
        self.sets: dict[bool, dict[tuple[str, ...], int]] = {False: {}, True: {}}

    def matches(self, patterns, mode: str = AUTO, case_sensitive: bool = False) -> Column:
        """Does the name match one of the patterns?"""
        globs = tuple(dict.fromkeys(p for p in patterns if not reads_as_regex(p, mode)))
        hit = match_any(self.name, [p for p in patterns if reads_as_regex(p, mode)], mode, case_sensitive)
        if globs:
            sets = self.sets[case_sensitive]
            hit = hit | (F.get(self._column(case_sensitive), F.lit(sets.setdefault(globs, len(sets)))) != "")
        return hit

    def _column(self, case_sensitive: bool) -> Column:
        return F.col(f"{self.prefix}_{'exact' if case_sensitive else 'folded'}")

    def columns(self, needed: Column) -> dict[str, Column]:
        """The columns that the tests made so far refer to; null where no name is needed."""
        made = {}
        for case_sensitive, sets in self.sets.items():
            if not sets:
                continue
            end = f"({quote(self.END)})\\z"
            each = "".join(f"(?=(?:{_any_of(globs)}){end}|)" for globs in sets)
            found = F.regexp_replace(F.concat(self.name, F.lit(self.END)), f"(?s{'' if case_sensitive else 'iu'})\\A{each}.*\\z",
                                     ",".join(f"${i + 1}" for i in range(len(sets))))
            made[f"{self.prefix}_{'exact' if case_sensitive else 'folded'}"] = F.when(needed, F.split(found, ","))
        return made
