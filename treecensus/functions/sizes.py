"""Expressions over byte counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from treecensus import constants as C


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


def entry_capacity(datablocks: Column, metablocks: Column, size: Column) -> Column:
    """Allocated bytes; logical size only when no block count is known."""
    return F.when(
        datablocks.isNotNull() | metablocks.isNotNull(),
        (_zero(datablocks) + _zero(metablocks)) * C.BLOCK,
    ).otherwise(_zero(size))


def owner_capacity(datablocks: Column, metablocks: Column) -> Column:
    """Allocated bytes of the owner report: no fallback to the logical size."""
    return (_zero(datablocks) + _zero(metablocks)) * C.BLOCK


def text_to_bytes(text: Column) -> Column:
    """Size text to bytes; null when it is not a size."""
    shape = r"^([0-9]+\.?[0-9]*)([A-Za-z]*)\z"
    units = F.create_map(*[F.lit(x).cast(t) for u, b in C.UNIT_BYTES.items()
                           for x, t in ((u, "string"), (b, "double"))])
    number = F.regexp_extract(text, shape, 1).try_cast("double")
    factor = F.try_element_at(units, F.lower(F.regexp_extract(text, shape, 2)))
    return F.when(text.rlike(shape), F.floor(number * factor))


def _ladder(value: Column, labels: tuple[str, ...], step: float, pattern: str,
            short: bool) -> Column:
    number = value.cast("double")
    shown = None
    for i, label in enumerate(labels):
        scaled = number
        for _ in range(i):
            scaled = scaled / F.lit(step)
        if short and i == 0:
            text = F.concat(number.cast("bigint").cast("string"), F.lit(" B"))
        else:
            digits = F.call_function("format_number", scaled, F.lit(pattern))
            if short:
                digits = F.regexp_replace(digits, r"\.0$", "")
            text = F.concat(digits, F.lit(" " + label))
        if i == len(labels) - 1:
            shown = text if shown is None else shown.otherwise(text)
        else:
            fits = scaled < F.lit(step)
            shown = F.when(fits, text) if shown is None else shown.when(fits, text)
    return shown


def human_size(value: Column, base10: bool = False) -> Column:
    """Short display text such as ``1.4 GiB``; empty for null."""
    labels, step = (C.DECIMAL_LABELS, 1000.0) if base10 else (C.BINARY_LABELS, 1024.0)
    return F.when(value.isNull(), F.lit("")).otherwise(_ladder(value, labels, step, "0.0", True))


def format_bytes(value: Column, base10: bool = False) -> Column:
    """Display text with two decimals such as ``1.40 GiB``."""
    labels, step = (C.DECIMAL_LABELS, 1000.0) if base10 else (C.BINARY_LABELS, 1024.0)
    return _ladder(value, labels, step, "0.00", False)
