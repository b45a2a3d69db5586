"""Run labels and report text (X22, X23, K6 naming).

``run_label`` names a run from its parameters exactly as the reference names
its output file; ``model_title`` / ``views_subtitle`` parse such a name back
(on ``_metadata.file_name`` or a ``run`` partition column).  All JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowtrace.functions.core import ColumnOrName, _c, py_fixed

# --- fixed values: label texts that must equal the reference's ---------------
SUBTITLE_WITH_VIEWS = "All deaths with minimum {views} views"
SUBTITLE_DEFAULT = "Knowledge of deaths by month"
RE_MIN_VIEWS = r"minviews-(\d+)"
# -----------------------------------------------------------------------------


def compact_number(num: ColumnOrName) -> Column:
    """X22: '1.5 million', '2 million', '500 thousand', '999'.

    Python formats the exact binary value of ``num / 10**k`` half-even;
    :func:`py_fixed` reproduces that, ties included (999,500 -> '1000 thousand').
    """
    n = _c(num).cast("bigint")
    millions = F.replace(
        F.concat(py_fixed(n.cast("double") / F.lit(1_000_000.0), 1), F.lit(" million")),
        F.lit(".0 million"),
        F.lit(" million"),
    )
    thousands = F.concat(py_fixed(n.cast("double") / F.lit(1_000.0), 0), F.lit(" thousand"))
    return F.when(n >= 1_000_000, millions).when(n >= 1_000, thousands).otherwise(n.cast("string"))


def py_title(c: ColumnOrName) -> Column:
    """Python ``str.title()``: a letter is upper-cased when the previous
    character is not cased, else lower-cased ('o3mini' -> 'O3Mini', unlike
    Spark's ``initcap``)."""
    s = _c(c)
    chars = F.regexp_extract_all(s, F.lit(r"(?s)."), 0)

    def step(acc, ch):
        out = F.when(acc.getField("cased"), F.lower(ch)).otherwise(F.upper(ch))
        return F.struct(
            F.concat(acc.getField("s"), out).alias("s"), ch.rlike(r"^[\p{Lu}\p{Ll}\p{Lt}]$").alias("cased")
        )

    init = F.struct(F.lit("").alias("s"), F.lit(False).alias("cased"))
    return F.when(s.isNotNull(), F.aggregate(chars, init, step).getField("s"))


def model_title(file_name: ColumnOrName) -> Column:
    """X23 model part: text before the first '_'; upper-case if it contains 'gpt', else title-case; '-' -> ' '."""
    raw = F.split_part(_c(file_name), F.lit("_"), F.lit(1))
    return F.when(F.lower(raw).contains("gpt"), F.replace(F.upper(raw), F.lit("-"), F.lit(" "))).otherwise(
        py_title(F.replace(raw, F.lit("-"), F.lit(" ")))
    )


def min_views_of(file_name: ColumnOrName) -> Column:
    """The N of 'minviews-N' in a run name, NULL when absent (or 'none')."""
    f = _c(file_name)
    return F.when(f.rlike(RE_MIN_VIEWS), F.regexp_extract(f, RE_MIN_VIEWS, 1).try_cast("bigint"))


def views_subtitle(file_name: ColumnOrName) -> Column:
    """X23 subtitle: 'All deaths with minimum <compact N> views' or the default."""
    v = min_views_of(file_name)
    pre, post = SUBTITLE_WITH_VIEWS.split("{views}")
    return F.when(v.isNotNull(), F.concat(F.lit(pre), compact_number(v), F.lit(post))).otherwise(F.lit(SUBTITLE_DEFAULT))


def run_label(
    model: ColumnOrName,
    start: ColumnOrName | None = None,
    end: ColumnOrName | None = None,
    top_per_day: ColumnOrName | None = None,
    top_per_month: ColumnOrName | None = None,
    min_views: ColumnOrName | None = None,
    ext: str = ".csv",
) -> Column:
    """K6: ``<model>[_<start>][_to_<end>|_until_<end>]_<topday|topmonth>-<N|all>_minviews-<N|none><ext>``.

    '/' and ':' in the model become '-'; a top value of 0 is 'all'.  Each
    argument is a Column (or name) so the label can be derived per row.
    """
    m = F.replace(F.replace(_c(model), F.lit("/"), F.lit("-")), F.lit(":"), F.lit("-"))
    date_part = F.lit("")
    if start is not None:
        date_part = F.concat(F.lit("_"), _c(start).cast("string"))
    if end is not None:
        joiner = "_to_" if start is not None else "_until_"
        date_part = F.concat(date_part, F.lit(joiner), _c(end).cast("string"))

    def top(prefix: str, v: ColumnOrName) -> Column:
        v = _c(v)
        return F.concat(F.lit(prefix), F.when(v > 0, v.cast("string")).otherwise(F.lit("all")))

    if top_per_day is not None:
        sel = top("topday-", top_per_day)
    elif top_per_month is not None:
        sel = top("topmonth-", top_per_month)
    else:
        sel = F.lit("selection-unknown")
    mv_val = F.lit(None).cast("string") if min_views is None else _c(min_views).cast("string")
    mv = F.concat(F.lit("minviews-"), F.coalesce(mv_val, F.lit("none")))
    return F.concat(m, date_part, F.lit("_"), sel, F.lit("_"), mv, F.lit(ext))
