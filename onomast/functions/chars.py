"""Character tables behind the name functions: fixed values that results depend on."""

from __future__ import annotations

import unicodedata

# Hyphen spellings, plus signs and apostrophes that fold to one character.
HYPHENS = "-‐‑‒–—―−－⁻₋﹣"
PLUSES = "＋⁺₊﹢﬩"
APOSTROPHES = "＇′’"
#: Signs that identify a sample and are left after folding: plus, apostrophe, plus-minus, minus-plus, double prime, hyphen.
SIGNS = "+'±∓″\\-"

# Canonical term, its short forms, whether a number follows them.
ABBREVIATIONS = (
    ("sample", ("samp", "s"), True),
    ("patient", ("pt", "p"), True),
    ("batch", ("bat", "b"), True),
    ("replicate", ("rep", "r"), True),
    ("timepoint", ("tp",), True),
    ("control", ("ctrl", "ctl"), False),
    ("treatment", ("trt",), False),
    ("wildtype", ("wt",), False),
    ("knockout", ("ko",), False),
)


def fold_table() -> tuple[str, str]:
    """(from, to) for ``translate``: fullwidth ASCII to ASCII, and each sign to one spelling."""
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(PLUSES, "+") | dict.fromkeys(APOSTROPHES, "'")
    table.pop("-")
    return "".join(table), "".join(table.values())


def zeros() -> str:
    """The digit zero of every script, for a character class."""
    return "".join(chr(c) for c in range(0x110000) if unicodedata.decimal(chr(c), None) == 0)


def alias_pattern(alias: str, numbered: bool) -> str:
    r"""What a whole token must match: a one-letter alias needs a number, a longer numbered one may have one."""
    if not numbered:
        return alias
    return alias + (r"\p{Nd}+" if len(alias) == 1 else r"\p{Nd}*")


def alias_label(canonical: str, alias: str, numbered: bool) -> str:
    return f"{canonical} ({alias}<n>)" if numbered else f"{canonical} ({alias})"
