"""Small Column helpers shared by every module (X26, X28, X30, P8, tri-state).

All of these are JVM-side expressions: they stay inside whole-stage codegen.
Python's ``str.strip()``/``\\s``/``\\d`` are Unicode-aware while Java's are
not, so every regex that stands in for Python text handling carries ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's ``str.isspace()`` accepts (what ``str.strip()`` removes),
# derived from Python itself rather than written out.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def pystrip(c: ColumnOrName) -> Column:
    r"""Python ``str.strip()``: drop Unicode whitespace at both ends.

    ``btrim`` with Python's whitespace set only looks at the two ends; a
    regex ``^\s+|\s+$`` would try a match at every position of long texts.
    """
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


# Regex class of exactly those characters (Java's (?U)\s differs: no \x1c-\x1f).
PY_WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in PY_WHITESPACE) + "]"


def word_count(c: ColumnOrName) -> Column:
    """``len(s.split())`` for a string (0 for NULL or blank)."""
    s = pystrip(c)
    return F.when(s.isNull() | (s == ""), F.lit(0)).otherwise(F.size(F.split(s, PY_WS_CLASS + "+")))


def is_one_word(c: ColumnOrName) -> Column:
    """``len(s.split()) == 1`` without splitting: non-blank, no inner whitespace."""
    s = pystrip(c)
    return (s != "") & ~s.rlike(PY_WS_CLASS)


def tri_state(c: ColumnOrName) -> Column:
    """Exact-match tri-state: 'True' -> true, 'False' -> false, anything else -> NULL.

    Never ``cast(boolean)``: Spark would also accept 'yes', 'true', '1'.
    """
    c = _c(c)
    return F.when(c == "True", F.lit(True)).when(c == "False", F.lit(False)).otherwise(F.lit(None).cast("boolean"))


def tri_state_text(c: ColumnOrName) -> Column:
    """Inverse of :func:`tri_state` for the CSV wire format ('' for NULL)."""
    c = _c(c)
    return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit(""))


def parse_date(c: ColumnOrName) -> Column:
    """``strptime(s, '%Y-%m-%d')``: accepts unpadded month/day, NULL on garbage."""
    return F.try_to_date(_c(c), "yyyy-M-d")


def day_key(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def month_key(c: ColumnOrName) -> Column:
    """First seven characters of the ISO date: 'YYYY-MM'."""
    return F.date_format(_c(c), "yyyy-MM")


def mid_month(month: ColumnOrName) -> Column:
    """Anchor date for a monthly point: the 15th."""
    return F.to_date(F.concat(_c(month), F.lit("-15")))


def _two_product_err(a: Column, b: float) -> Column:
    """Exact rounding error of ``a * b`` in double arithmetic (Dekker, no FMA)."""
    split = F.lit(134217729.0)  # 2**27 + 1
    ca = a * split
    ah = ca - (ca - a)
    al = a - ah
    cb = float(b) * 134217729.0
    bh = cb - (cb - float(b))
    bl = float(b) - bh
    p = a * F.lit(float(b))
    return ((ah * F.lit(bh) - p) + ah * F.lit(bl) + al * F.lit(bh)) + al * F.lit(bl)


def py_round_units(c: ColumnOrName, digits: int) -> Column:
    """``round(x * 10**digits)`` as Python's fixed-point formatting does it.

    Python formats the *exact* binary value and breaks exact ties to even;
    Spark's ``format_string``/``bround`` round the shortest decimal repr
    half-up/half-even instead (1.15 -> '1.2' where Python gives '1.1').  The
    exact product ``x * 10**d = p + err`` is recovered with Dekker's
    two-product, so the tie test is exact.  Defined for x >= 0.
    """
    x = _c(c).cast("double")
    m = 10.0**digits
    p = x * F.lit(m)
    err = _two_product_err(x, m)
    k = F.floor(p)
    diff = (p - (k.cast("double") + F.lit(0.5))) + err
    return (
        F.when(diff > 0, k + 1)
        .when(diff < 0, k)
        .otherwise(F.when(k % 2 == 0, k).otherwise(k + 1))
        .cast("bigint")
    )


def py_fixed(c: ColumnOrName, digits: int = 1, grouping: bool = False) -> Column:
    """``f'{x:.{digits}f}'`` (or ``f'{x:,.{digits}f}'``) for x >= 0, NULL stays NULL."""
    units = py_round_units(c, digits)
    scale = 10**digits
    whole = F.floor(units / F.lit(scale)).cast("bigint") if digits else units
    whole_txt = F.format_number(whole, 0) if grouping else whole.cast("string")
    if digits == 0:
        return whole_txt
    frac = F.lpad((units % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(whole_txt, F.lit("."), frac)


def pct_text(c: ColumnOrName, digits: int = 1) -> Column:
    """'12.3%' style text, 'N/A' for NULL."""
    c = _c(c)
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.concat(py_fixed(c, digits), F.lit("%")))


def thousands(c: ColumnOrName) -> Column:
    """'{:,}' for integers."""
    return F.format_number(_c(c), 0)


def accuracy_pct(correct: ColumnOrName, known: ColumnOrName) -> Column:
    """``correct / known * 100`` with NULL for a zero denominator.

    Division first, then x100, to keep the reference's float rounding.
    """
    return F.try_divide(_c(correct).cast("double"), _c(known).cast("double")) * F.lit(100.0)
