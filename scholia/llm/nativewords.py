"""Words of texts by Spark's own expressions.

Word rule: ASCII letters lower-cased, then runs of digits, a-z and everything from U+0080 up. ``folded_words`` lower-cases other
letters too, which Spark does faster; it has as many words, and equal words stay equal, so it serves counts and filters.
(Capital sigma is taken apart first, since its lower case depends on its neighbours.)
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ"))), F.lit(WORD), F.lit(0))


def exact_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))
