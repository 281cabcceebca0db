"""The reject classifier: one expression that gives the first reason that holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions import lexicon as lx

#: Patterns of an early variant of the filter, tried together.
# Fixed values.
NOISE = [
    r"^\d+[\.\d]*\s+[A-Z]",
    r"(?i)^(table|figure|appendix)\s",
    r"(?i)^(revision history|change log)",
    r"^\w+\s*:\s*\w+",
    r"\|\s*\w+\s*\|",
    r"(?i)^(note|notes?|warning|caution)\s*:",
    r"^\[SRSreq\s*\d+\]",
]


def rule(x: Column, reason: str, pattern: str) -> Column:
    """Whether one rule holds."""
    least = lx.REJECT_COUNTS.get(reason, 1)
    holds = x.rlike(pattern) if least == 1 else F.regexp_count(x, F.lit(pattern)) >= least
    if reason == "ocr_corruption":
        holds = holds | (F.length(F.regexp_replace(x, r"[\x00-\x7F]", "")) > F.length(x) * lx.NON_ASCII_SHARE)
    return holds


def reason(x: Column, words: Column, external: Column | bool = False, rules: list[tuple[str, str]] = lx.REJECT_RULES, least: int = lx.MIN_WORDS, most: Column | int = lx.MAX_WORDS) -> Column:
    """The first reason to reject a text, or null: its length, no modal, the rules in order, references where ``external``.

    A CASE stops at the first that holds, so the cheap gates come first.
    """
    found = F.when(~words.between(least, most), "word_count").when(~x.rlike("(?i)" + lx.MODAL_GATE), "no_modal_verb")
    for name, pattern in rules:
        found = found.when(rule(x, name, pattern), name)
    external = F.lit(external) if isinstance(external, bool) else external
    return found.when(external & x.rlike(lx.EXTERNAL_REFERENCE), "external_reference")


def noisy(x: Column, patterns: list[str] = NOISE) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | x.rlike(p)
    return found
