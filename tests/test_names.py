"""Patterns and new names against Python's own re and fnmatch."""

import fnmatch
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from treecensus.functions import patterns as P, rename as R
from treecensus.options import OptionError

NAMES = ["a.log", "a.log\n", "A.LOG", ".git", "C++ notes.txt", "test_foo.py", "mytest_1", "noext", "café",
         "cafe\u0301", "CAFÉ", "file_1", "myfile_1", "x[1].txt", "a-b", "a{b", "1.2.3", "é", "", "tab\there", "a&&b"]
PATTERNS = ["*.log", "file_*", "*", "?", "[a-c]*", "[!a-c]*", "x[[]1].txt", ".*", "^file", "log$", r"\.(log|txt)$",
            "C++*", "a{b", r"\d+", r"[\w]+\.py", "caf?", "CAFÉ", "[]a]*", "[!]a]*", "a&&b", "[a&&b]+", "test_*",
            r"(?P<first_part>a)\.log", "[z-a]x", "a-b", "{1,2}", "x{,2}y", "no match"]


def python_search(pattern, mode, case):
    regex = pattern
    special = set("^$.+()|{}\\")
    as_regex = mode == "regex"
    if mode == "auto":
        as_regex = pattern.startswith("^") or pattern.endswith("$")
        if not as_regex and special & set(pattern):
            try:
                re.compile(pattern)
                as_regex = True
            except re.error:
                pass
    if not as_regex:
        regex = r"\A" + fnmatch.translate(pattern)
    return re.compile(regex, 0 if case else re.IGNORECASE)


@pytest.mark.parametrize("mode", [P.AUTO, P.GLOB, P.REGEX])
@pytest.mark.parametrize("case", [True, False])
def test_matching_equals_python(spark, mode, case):
    chosen = []
    for pattern in PATTERNS:
        try:
            chosen.append((pattern, python_search(pattern, mode, case)))
        except re.error:
            with pytest.raises(OptionError):
                P.name_regex(pattern, mode, case)
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = names.select("n", *[P.match_name(F.col("n"), p, mode, case).alias(f"c{i}")
                              for i, (p, _) in enumerate(chosen)]).collect()
    for row in got:
        for i, (pattern, regex) in enumerate(chosen):
            assert row[f"c{i}"] == bool(regex.search(row["n"])), (pattern, row["n"])


@pytest.mark.parametrize("mode", [P.AUTO, P.GLOB])
def test_names_looked_for_in_one_pass_equal_single_tests(spark, mode):
    names = spark.createDataFrame([(n,) for n in [*NAMES, "\x01", "a.log\x01", "ſ.LOG", "a,b", None]], "n string")
    globs = [p for p in PATTERNS if mode == P.GLOB or p != "[z-a]x"]
    sets = [globs[i:i + 3] for i in range(0, len(globs), 2)] + [[g] for g in globs] + [[]]  # overlapping, and over 9 groups
    shared = P.SharedNames(F.col("n"))
    one = [shared.matches(s, mode, case).alias(f"x{case:d}_{i}") for case in (True, False) for i, s in enumerate(sets)]
    each = [P.match_any(F.col("n"), s, mode, case).alias(f"y{case:d}_{i}") for case in (True, False) for i, s in enumerate(sets)]
    for row in names.withColumns(shared.columns(F.lit(True))).select("n", *one, *each).collect():
        for c in (0, 1):
            for i, s in enumerate(sets):
                assert row[f"x{c}_{i}"] == row[f"y{c}_{i}"], (row["n"], s)


@given(st.text(alphabet="ab*?[]!-.x^\\", max_size=8))
@settings(max_examples=300, deadline=None)
def test_glob_body_equals_fnmatch(glob):
    # globs use no construct that Python and Java read differently, apart from code points and end anchors
    body = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), P.glob_body(glob))
    ours = re.compile(r"(?s)\A(?:" + body + r")\Z")
    theirs = re.compile(fnmatch.translate(glob))
    for name in ("a", "b", "ab", "a.x", "[a]", "-", "!", "^", "\\", "]", "abx", "", "[", "*", "a-b"):
        assert bool(ours.search(name)) == bool(theirs.match(name)), (glob, name)


def test_ambiguous_patterns():
    assert P.ambiguous(".*") and P.ambiguous("report.docx")
    assert not any(map(P.ambiguous, ["*.log", "^[0-9]", "log$", "file_*", "name"]))


def names_after(spark, names, rename):
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    return [r[0] for r in frame.select(rename(F.col("n"))).collect()]


@pytest.mark.parametrize("pattern,name,expected", [
    ("{my|our}", "my_file_1.jpg", "our_file_1.jpg"),
    ("{IMG_*|photo_*}", "IMG_2024.jpg", "photo_2024.jpg"),
    (r"{(\d+)|v\1}", "scan12.tif", "scanv12.tif"),
    ("{_old|}", "a_old.txt", "a.txt"),
    (r"{\d{2}|N}", "a1234b5", "aNNb5"),
    ("{a|b}{b|c}", "aab", "ccc"),
    ("{x|$1\\\\}", "axb", "a$1\\b"),
    (r"{(a)|\1\2\0!}", "cat", "ca!t"),
    (r"{(a)|\10}", "cat", "ca0t"),
    ("{a?c|[?]}", "abc-adc", "[b]-[d]"),
    (r"{(a){0,1}b|<\1>}", "b ab", "<> <a>"),
    (r"{(a)?b|<\1\2>}", "b axb", "b <ax>"),
    ("{.jpeg|.jpg}", "r.jpeg", "r.jpg"),
    ("{*|x}", "ab", "xx"),
    ("{a|b|c}", "a", "b|c"),
])
def test_substitution(spark, pattern, name, expected):
    assert names_after(spark, [name], R.renamer(pattern)) == [expected]


def test_template(spark):
    new = R.renamer("our_*-?", ["my_*", "my_*.?", "*_[x]?"])
    assert names_after(spark, ["my_a.b", "your_a", "q_[x]1", "my_ab"], new) == ["our_a-b", None, "our_q-1", None]
    assert names_after(spark, ["a", "b"], R.renamer("same.txt")) == ["same.txt", "same.txt"]
    assert names_after(spark, ["my_A", "MY_A"], R.renamer("x*", ["my_*"])) == ["xA", None]


@pytest.mark.parametrize("pattern", ["", "{a|b", "{ab}", "{|b}", "{a|b}x", "pre{a|b}", "{(|b}", "x*"])
def test_bad_rename(pattern):
    with pytest.raises(OptionError):
        R.renamer(pattern)


def test_literal_braces_are_no_token(spark):
    assert names_after(spark, ["a"], R.renamer("file{1}.txt")) == ["file{1}.txt"]


def test_conflict_suffix(spark):
    from datetime import datetime

    suffix = R.suffix_text(datetime(2026, 6, 25, 14, 30, 5))
    got = names_after(spark, ["report.docx", ".git", "noext", "a.tar.gz"], lambda n: R.with_suffix(n, suffix))
    stamp = "_restored_2026-06-25_14-30-05"
    assert got == [f"report{stamp}.docx", f".git{stamp}", f"noext{stamp}", f"a.tar{stamp}.gz"]
    assert R.suffix_text(datetime(2026, 6, 25), "_{snapshot}_{date}", 7) == "_7_2026-06-25"
