"""Operator 8, personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is a column expression over a document's own row: no join, no shuffle, no Python.
The patterns say the same as their plain forms in ``KINDS`` but never look at a character more
than a few times (possessive repeats, and starts only where a run begins), so that long texts of
one repeated character stay cheap.  Positions count code points; ends are exclusive.

Base kinds (always kept when their check holds): email, ip, card, phone.  Added kinds: iban
(mod-97), ssn and secret, which also need a score of ``LEAST`` from checks and nearby words.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

LEAST = 0.5
NEAR = 40
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right is doubled (9 taken off above 9); the sum ends in 0."""
    d = digits(value)
    n = F.length(d)

    def add(total, i):
        digit = F.substring(d, i, F.lit(1)).cast("int")
        twice = 2 * digit
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """The account number with its first four characters moved to the end, letters as 10 to 35, leaves 1."""
    bare = F.regexp_replace(F.upper(value), "[^0-9A-Z]", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def add(rest, i):
        c = F.substring(turned, i, F.lit(1))
        letter = F.instr(F.lit(LETTERS), c)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).otherwise((rest * 10 + c.cast("int")) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def size_of_digits(value: Column, least: int, most: int) -> Column:
    return F.length(digits(value)).between(least, most)


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str
    check: Callable[[Column], Column]
    score: float
    words: str
    base: bool = False


# Kinds in the order in which they are listed, with their patterns.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda v: F.lit(True), 0.8, "mail|write|contact", True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]",
         lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), 0.7, "host|server|address|ip", True),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]",
         lambda v: F.when(size_of_digits(v, 16, 19), luhn(v)).otherwise(False), 0.8, "card|visa|pay|credit", True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "[+][0-9]",
         lambda v: size_of_digits(v, 8, 15), 0.7, "call|phone|tel|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}", mod97, 0.8, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]",
         lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social|security"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_?key) ?[=:] ?[\"']?[^\s\"',;]{8,}+)",
         "AKIA|(?i)(?:pass|secret|token|key)[a-z]{0,4} ?[=:]", lambda v: F.lit(True), 0.6, "key|login|user"),
)


def _found(kind: Kind, number: int) -> tuple[Column, Column]:
    """Starts and spans of a kind, from its matches and the gaps between them."""
    m, g = F.col(f"_m{number}"), F.col(f"_g{number}")
    walk = F.aggregate(
        F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, i: F.struct(
            (a["at"] + F.length(F.get(g, i)) + F.length(F.get(m, i))).alias("at"),
            F.array_append(a["starts"], a["at"] + F.length(F.get(g, i))).alias("starts")))
    starts = F.col(f"_s{number}")

    def span(value, i):
        start = F.get(starts, i)
        near = F.concat_ws(" ", F.substring(F.get(g, i), F.greatest(F.length(F.get(g, i)) - NEAR + 1, F.lit(1)), F.lit(NEAR)),
                           F.substring(F.get(g, i + 1), F.lit(1), F.lit(NEAR)))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(f"(?i)(?:{kind.words})"), 0.2).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"),
                        value.alias("value"), score.alias("score"))

    spans = F.filter(F.transform(m, span), lambda s: kind.check(s["value"]) & (F.lit(kind.base) | (s["score"] >= LEAST)))
    return walk["starts"], F.when(F.size(m) > 0, spans).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def find(documents: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``spans`` to documents with a column ``text``: kind, start, end, value and score of each.

    Spans are in the order of kinds, then of starts; those of one kind do not overlap.  A null or
    empty text has none.  All other columns stay; columns named ``spans`` or ``_m0`` and the like
    are replaced.
    """
    names = [c for c in documents.columns if c != "spans"]
    rows = documents.select(*names)
    none = F.array().cast("array<string>")
    rows = rows.select("*", *(F.when(F.col("text").rlike(k.hint), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)))
                              .otherwise(none).alias(f"_m{i}") for i, k in enumerate(kinds)))
    rows = rows.select("*", *(F.when(F.size(f"_m{i}") > 0, F.split("text", k.pattern, -1)).otherwise(none).alias(f"_g{i}")
                              for i, k in enumerate(kinds)))
    rows = rows.select("*", *(F.when(F.size(f"_m{i}") > 0, _found(k, i)[0]).alias(f"_s{i}") for i, k in enumerate(kinds)))
    return rows.select(*names, F.concat(*(_found(k, i)[1] for i, k in enumerate(kinds))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(documents: DataFrame, spans: str = "spans") -> DataFrame:
    """Replaces each found span of ``text`` by its kind in angle brackets; overlapping spans leave the first.

    What a later span has beyond the one it overlaps is removed too, so nothing found survives.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.col("text")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        added = F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]),
                                             F.concat(F.lit("<"), s["kind"], F.lit(">"))))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, added).otherwise(a["parts"]).alias("parts"))

    done = F.aggregate(order, state, step, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return documents.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(text))
