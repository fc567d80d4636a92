"""Text options typed by a user, checked on the driver before a plan is built."""

from __future__ import annotations

import re
from datetime import timedelta

from treecensus import constants as C


class OptionError(ValueError):
    """An option is malformed."""


def size_bytes(text: str | int) -> int:
    """``1.5GiB`` -> 1610612736; a bare number is bytes."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"(\d+(?:\.\d*)?)([A-Za-z]*)", text, flags=re.ASCII)
    if found is None or found[2].lower() not in C.UNIT_BYTES:
        raise OptionError(f"not a size: {text!r}")
    return int(float(found[1]) * C.UNIT_BYTES[found[2].lower()])


def duration(text: str | int) -> timedelta:
    """``5`` or ``5d`` is days, ``12h`` is hours."""
    found = re.fullmatch(r"(\d+(?:\.\d+)?)([dh]?)", str(text).strip().lower())
    if found is None:
        raise OptionError(f"not a duration: {text!r}")
    amount = float(found[1])
    return timedelta(hours=amount) if found[2] == "h" else timedelta(days=amount)


def split_list(text: str) -> list[str]:
    """Comma list without blanks and repeats, in the order given."""
    return list(dict.fromkeys(word.strip() for word in text.split(",") if word.strip()))


def attributes(text: str, allowed=C.ATTRIBUTES) -> list[str]:
    """Attribute list in canonical names."""
    names = [C.ATTRIBUTE_WORDS.get(w.lower(), w.lower()) for w in split_list(text)]
    unknown = [n for n in names if n not in allowed]
    if unknown:
        raise OptionError(f"unknown attribute {unknown[0]!r}; choose from {', '.join(sorted(allowed))}")
    return list(dict.fromkeys(names))


def field_paths(text: str) -> list[tuple[str, str]]:
    """Field list as (shown name, column path); a path has two parts at most."""
    pairs = []
    for word in split_list(text):
        if word in C.FIELD_WORDS:
            pairs.append((word, C.FIELD_WORDS[word]))
            continue
        head, dot, tail = word.partition(".")
        if head == "attr" and dot:
            if not tail:
                raise OptionError("attr. needs an attribute name")
            pairs.append((word, f"extended_attributes.{tail}"))
        elif "." in tail:
            raise OptionError(f"field {word!r} is nested too deeply")
        else:
            pairs.append((word, word))
    return pairs


def rights(text: str) -> list[str]:
    """``Read+w`` -> letters in canonical order."""
    letters: set[str] = set()
    for word in text.split("+"):
        found = C.RIGHT_PRESETS.get(word.lower(), word)
        bad = set(found) - set(C.RIGHTS)
        if bad or not found:
            raise OptionError(f"unknown right in {text!r}")
        letters |= set(found)
    return [letter for letter in C.RIGHTS if letter in letters]


def trustee(text: str) -> str:
    """One spelling per trustee: a bare number is a UID, ``sid:`` is optional."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return f"uid:{text}"
    return text[4:] if text.lower().startswith("sid:s-") else text


def _kind(word: str) -> str:
    kinds = {"allow": C.ALLOW, "allowed": C.ALLOW, "deny": C.DENY, "denied": C.DENY}
    if word.lower() not in kinds:
        raise OptionError(f"entry type must be Allow or Deny, not {word!r}")
    return kinds[word.lower()]


def ace_key(text: str) -> tuple[str, str]:
    """``Type:Trustee``; only the first colon separates."""
    kind, colon, who = text.partition(":")
    if not colon or not who:
        raise OptionError(f"expected Type:Trustee, got {text!r}")
    return _kind(kind), trustee(who)


def ace_rights(text: str) -> tuple[str, str, list[str]]:
    """``Type:Trustee:Rights``; the last colon starts the rights."""
    head, colon, tail = text.rpartition(":")
    if not colon:
        raise OptionError(f"expected Type:Trustee:Rights, got {text!r}")
    return (*ace_key(head), rights(tail))


def ace_full(text: str) -> tuple[str, list[str], str, list[str]]:
    """``Type:Flags:Trustee:Rights``; the trustee may hold colons."""
    parts = text.split(":")
    if len(parts) < 4:
        raise OptionError(f"expected Type:Flags:Trustee:Rights, got {text!r}")
    flags = list(dict.fromkeys(parts[1]))
    if set(flags) - set("fd"):
        raise OptionError(f"unknown inheritance flag in {text!r}")
    return _kind(parts[0]), flags, trustee(":".join(parts[2:-1])), rights(parts[-1])


def mapping_pair(text: str) -> tuple[str, str]:
    """``old:new`` where either side may be ``uid:N``, ``gid:N``, ``sid:S-..`` or ``auth_id:N``."""
    found = re.fullmatch(
        r"((?:(?:uid|gid|sid|auth_id):)?[^:]+):((?:(?:uid|gid|sid|auth_id):)?[^:]+)", text)
    if found is None:
        raise OptionError(f"expected OLD:NEW, got {text!r}")
    return trustee(found[1]), trustee(found[2])
