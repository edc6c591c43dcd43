"""Free-text description rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _c

# The phrase of each uncertainty flag and the synonym table of the label guide.
FLAG_PHRASES = {
    "unclear": "unclear signs of agriculture",
    "slightly_green": "only slightly green",
    "uneven": "uneven",
    "natural": "may naturally be green",
    "fishpond": "may be a fishpond",
}
UNCERTAINTY_PHRASES = list(FLAG_PHRASES.values())
CATEGORY_SYNONYMS = {
    "tree_crop": ["agroforestry", "plantation", "tree crop"],
    "industrial": ["industrial", "commercial"],
    "lawn": ["lawn"],
    "covered": ["covered"],
}
DEFAULT_CATEGORY = "small-scale"
DEFAULT_CERTAINTY = 5
MATCH_THRESHOLD = 75.0
BLANKS = " \t\n\r\x0b\x0c"


def strip(c) -> Column:
    """Trim every kind of blank, not just spaces."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def normalize(c) -> Column:
    """Lower case, trimmed, only a-z and blanks."""
    return F.regexp_replace(strip(F.lower(_c(c))), r"[^a-z\s]", "")


def certainty_of(description) -> Column:
    """First character as a number, else 5."""
    first = F.substring(strip(description), 1, 1)
    return F.when(first.rlike("^[0-9]$"), first.try_cast("int")).otherwise(F.lit(DEFAULT_CERTAINTY))
