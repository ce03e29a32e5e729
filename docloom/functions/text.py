"""Text predicates and measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of a refusal, looked for in lower case.
REFUSALS = ("죄송", "답변할 수 없", "i cannot", "i can't", "as an ai")


def non_blank(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def category_of(name: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(name, "_", 1)


def strip_reasoning(c: Column) -> Column:
    """Without <think> blocks; an unclosed one cuts the rest."""
    return F.trim(F.substring_index(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), "<think>", 1))


def is_refusal(c: Column) -> Column:
    return F.coalesce(F.greatest(*[F.contains(F.lower(c), F.lit(p)) for p in REFUSALS]), F.lit(False))


#: The visible characters of a text of full length, and the classes of characters, as insides of a character class.
FULL_LENGTH = 1200
SPACES = r"\x{09}\x{0A}\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MEANINGFUL = r"0-9A-Za-z\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}"
CONTROLS = r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}"


def quality(c: Column) -> Column:
    """0 to 1 from the share of meaningful among visible characters and from length, less for control and replacement characters.

    Spaces, control and replacement characters aren't visible. Characters are counted by taking runs of the others out.
    """
    left = lambda text, inside: F.length(F.regexp_replace(text, f"[{inside}]+", ""))
    points = F.greatest(F.length(c), F.lit(1))
    # no meaningful character is counted below, so the whole text is gone through once and what else is in it, a small part, thrice
    rest = F.regexp_replace(c, f"[{MEANINGFUL}]+", "")
    others = F.length(rest)
    visible = F.length(c) - others + left(rest, SPACES + CONTROLS + r"\x{FFFD}")
    replaced, controls = others - left(rest, r"\x{FFFD}"), others - left(rest, CONTROLS)
    q = 0.55 * (F.length(c) - others) / F.greatest(visible, F.lit(1)) + 0.45 * F.least(F.lit(1.0), F.log1p(visible) / F.log1p(F.lit(FULL_LENGTH))) - 1.5 * replaced / points - controls / points
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))
