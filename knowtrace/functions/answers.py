"""Answer parsing and response-text composition.

All are Column expressions (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowtrace.functions.core import ColumnOrName, _c

# --- fixed values: texts that must equal the reference's output -------------
AMBIGUOUS_MSG = "Ambiguous response (contains both 'yes' and 'no'): '{answer}'"
INVALID_MSG = "Invalid response (no 'yes' or 'no' found): '{answer}'"
PARSE_ERROR_FMT = "{answer} (parse error: {error})"
NO_RESULT = "No result"
NO_CANDIDATES = "Error: No candidates in response"
NO_RESPONSE_OR_ERROR = "Error: No response or error in result"
INLINE_UNPARSABLE = "Error: Could not parse response"
INLINE_NO_RESPONSE = "Error: No response"
ERROR_PREFIX = "Error: "
PARSING_ERROR_PREFIX = "Error parsing response: "
# Model-name routing substrings, tested in this order (first match wins).
FAMILY_ROUTES = (("gemini", "batch-jsonl"), ("claude", "batch-typed"))
DEFAULT_FAMILY = "sequential"
# -----------------------------------------------------------------------------


def _has(norm: Column, word: str, whole_word: bool) -> Column:
    if whole_word:
        return norm.rlike(rf"(?U)\b{word}\b")
    return norm.contains(word)


def yes_no(answer: ColumnOrName, whole_word: bool = False) -> Column:
    """X19: 'no' -> true (knows the subject died), 'yes' -> false, both/neither -> NULL.

    A *substring* test by default, as in the reference: "I don't know"
    contains 'no' and counts as true (D7).  ``whole_word=True`` opts out.
    """
    # Stripping whitespace cannot create or remove a 'yes'/'no' substring (or a
    # word boundary around one), so the test runs on the lowered raw text.
    norm = F.lower(F.coalesce(_c(answer), F.lit("")))
    y, n = _has(norm, "yes", whole_word), _has(norm, "no", whole_word)
    return F.when(y & n, F.lit(None)).when(y, F.lit(False)).when(n, F.lit(True)).otherwise(F.lit(None)).cast("boolean")


def yes_no_error(answer: ColumnOrName, whole_word: bool = False) -> Column:
    """X20 error half: the reference's ValueError text, NULL when the answer parses."""
    raw = F.coalesce(_c(answer), F.lit(""))
    norm = F.lower(raw)
    y, n = _has(norm, "yes", whole_word), _has(norm, "no", whole_word)
    amb_a, amb_b = AMBIGUOUS_MSG.split("{answer}")
    inv_a, inv_b = INVALID_MSG.split("{answer}")
    return F.when(y & n, F.concat(F.lit(amb_a), raw, F.lit(amb_b))).when(
        ~y & ~n, F.concat(F.lit(inv_a), raw, F.lit(inv_b))
    )


def yes_no_safe(answer: ColumnOrName, whole_word: bool = False) -> Column:
    """struct(knows, error) - never raises."""
    return F.struct(yes_no(answer, whole_word).alias("knows"), yes_no_error(answer, whole_word).alias("error"))


def response_text(answer: ColumnOrName, error: ColumnOrName) -> Column:
    """The answer itself, or ``'<answer> (parse error: <msg>)'``."""
    a, e = F.coalesce(_c(answer), F.lit("")), _c(error)
    pre, mid = PARSE_ERROR_FMT.split("{answer}")
    mid_a, mid_b = mid.split("{error}")
    return F.when(e.isNull(), a).otherwise(F.concat(a, F.lit(mid_a), e, F.lit(mid_b)))


def error_text(kind: ColumnOrName) -> Column:
    """``'Error: <kind>'``."""
    return F.concat(F.lit(ERROR_PREFIX), _c(kind))


def key_index(key: ColumnOrName, prefix: str = "request-") -> Column:
    """Index of a ``request-<i>`` key; NULL for any other key (line rejected)."""
    k = _c(key)
    return F.when(k.startswith(prefix), F.split_part(k, F.lit("-"), F.lit(2)).try_cast("bigint"))


def first_text(parts: ColumnOrName) -> Column:
    """Text of the first part that has one (``get`` never raises on a short array)."""
    return F.get(F.filter(_c(parts), lambda p: p.getField("text").isNotNull()), F.lit(0)).getField("text")


def model_family(model: ColumnOrName) -> Column:
    """Route a model name to its request family by substring, in order."""
    m = F.lower(_c(model))
    out = None
    for needle, fam in FAMILY_ROUTES:
        out = F.when(m.contains(needle), F.lit(fam)) if out is None else out.when(m.contains(needle), F.lit(fam))
    return out.otherwise(F.lit(DEFAULT_FAMILY))
