"""Column functions for one entry line of a monthly death-list page.

They are listed in execution order; ``operators.wikitext`` composes them.
Java regex stands in for Python's ``re``: ``(?U)`` makes ``\\s``/``\\d``
Unicode-aware like Python's, ``(?iU)`` is ``re.IGNORECASE``, group
references in replacements are ``$n``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowtrace.functions.core import ColumnOrName, _c, is_one_word, pystrip, word_count

# --- fixed values: patterns and texts that must equal the reference's ---------
END_SECTIONS = ("References", "See also", "External links", "Notes", "Further reading")
RE_END = r"(?iU)^==+\s*(References|See also|External links|Notes|Further reading)\s*==+"
RE_DAY = r"(?U)^==+\s*(\d{1,2})\s*==+"
RE_TOP = r"^\*[^*]"
RE_BULLETS = r"(?U)^\*+\s*"
RE_COMMENT = r"<!--[^>]*-->"
RE_EXT_LINK = r"\[https?://[^\]]*\]"
RE_FOREIGN = r"^\{\{ill\|([^|}]+)\|([^|}]+)"
RE_CIRCA = (r"(?iU)\{\{circa\}\}\s*", r"(?iU)\{\{c\.\}\}\s*")
CIRCA_TEXT = "c. "
RE_LEAD_LINK = r"^\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
RE_AGE = r"(?U)^\s*,\s*(\d{1,3}(?:[–—-]\d{1,3})?s?)\s*,"
RE_CIRCA_AGE = r"(?U)^\s*,\s*c\.\s*(\d{1,3}(?:[–—-]\d{1,3})?s?)\s*,"  # not in the reference (D4)
RE_LEAD_COMMA = r"(?U)^\s*,\s*"
RE_LINK = r"\[\[([^\]|]+\|)?([^\]]+)\]\]"
RE_TAG = r"<[^>]+>"
RE_TEMPLATE = r"\{\{[^}]+\}\}"
EDGE_PUNCT = " ,;"
RE_YEAR_RANGE = r"(?U)\(\d{4}[–—-]\d{4}\)"
RE_TWO_LETTER = r"^[A-Z][a-z]$"
RE_PUNCT_ONLY = r"(?U)^[\s\-:;,\.]+$"
RE_PEOPLE = r"(?iU)([A-Z][a-z]+)\s+people\s+(?:killed|who\s+died)\s+in"
RE_SINGULAR = r"(?iU)(?:Notable\s+)?([A-Z][a-z]+(?:[-\s][a-z]+)+)\s+(?:killed|who\s+died)\s+in\s+the"
RE_PLURAL = (
    r"(?iU)(?:Notable\s+)?([A-Z][a-z]+(?:[-\s][A-Z]?[a-z]+)*s)(?:\s+[a-z]+(?:\s+[a-z]+)*)?"
    r"\s+(?:killed|who\s+died)\s+in\s+the"
)
MONTH_TITLE_PREFIX = "Deaths in "
# Reject codes in the order the checks run (the first failing check wins).
REJECT_CODES = (
    "foreign_only",
    "not_link",
    "bad_link",
    "colon",
    "short_name",
    "bad_two_letter",
    "no_content",
    "short_desc",
    "one_word",
    "punct_only",
    "invalid_date",
)
# -----------------------------------------------------------------------------

# Rejects the reference hands to the corrections prompt (with or without a parsed name).
CORRECTABLE = REJECT_CODES[1:10]
NAME_CHECKED = ("colon", "short_name", "bad_two_letter", "no_content", "short_desc", "one_word", "punct_only")


# Line classification (used by the page line-state windows) -------------------


def is_end_section(line: ColumnOrName) -> Column:
    ln = _c(line)
    return ln.startswith("==") & ln.rlike(RE_END)


def header_day(line: ColumnOrName) -> Column:
    """Day number of a day header line, NULL for any other line."""
    ln = _c(line)
    return F.when(ln.startswith("==") & ln.rlike(RE_DAY), F.regexp_extract(ln, RE_DAY, 1).try_cast("int"))


def is_top_bullet(line: ColumnOrName) -> Column:
    return _c(line).rlike(RE_TOP)


def is_sub_bullet(line: ColumnOrName) -> Column:
    return _c(line).startswith("**")


# Entry chain X1-X12 ----------------------------------------------------------


def strip_bullets(c: ColumnOrName) -> Column:  # X1
    return F.regexp_replace(_c(c), RE_BULLETS, "")


def _guarded(c: Column, needle: str, out: Column) -> Column:
    """Run a rewrite only on strings that contain its marker (most lines do not)."""
    return F.when(c.contains(needle), out).otherwise(c)


def strip_comments(c: ColumnOrName) -> Column:  # X2 (no trim afterwards)
    c = _c(c)
    return _guarded(c, "<!--", F.regexp_replace(c, RE_COMMENT, ""))


def strip_ext_links(c: ColumnOrName) -> Column:  # X3
    c = _c(c)
    return _guarded(c, "[http", F.regexp_replace(c, RE_EXT_LINK, ""))


def foreign_link(c: ColumnOrName) -> Column:  # X4: anchored, case-sensitive
    return _c(c).rlike(RE_FOREIGN)


def norm_circa(c: ColumnOrName) -> Column:  # X5
    c = _c(c)
    out = c
    for pat in RE_CIRCA:
        out = F.regexp_replace(out, pat, CIRCA_TEXT)
    return _guarded(c, "{{", out)


def lead_link(entry: ColumnOrName) -> Column:  # X6
    """struct(ok, title, name, rest): the leading ``[[target|display]]`` link."""
    e = _c(entry)
    ok = e.rlike(RE_LEAD_LINK)
    target = pystrip(F.regexp_extract(e, RE_LEAD_LINK, 1))
    display = F.regexp_extract(e, RE_LEAD_LINK, 2)
    name = pystrip(F.when(display != "", display).otherwise(target))
    rest = F.regexp_replace(e, RE_LEAD_LINK, "")
    return F.struct(ok.alias("ok"), target.alias("title"), name.alias("name"), rest.alias("rest"))


def drop_age(after_name: ColumnOrName, fix_circa: bool = False) -> Column:  # X7: the age itself is discarded
    """``fix_circa`` takes ``c. 73,`` for an age as well; without it the age stays as the description."""
    a = _c(after_name)
    out = F.when(a.rlike(RE_AGE), F.regexp_replace(a, RE_AGE, ""))
    if fix_circa:
        out = out.when(a.rlike(RE_CIRCA_AGE), F.regexp_replace(a, RE_CIRCA_AGE, ""))
    return out.otherwise(F.regexp_replace(a, RE_LEAD_COMMA, ""))


def unwrap_links(c: ColumnOrName) -> Column:  # X8
    c = _c(c)
    return _guarded(c, "[[", F.regexp_replace(c, RE_LINK, "$2"))


def strip_markup(c: ColumnOrName) -> Column:  # X9: tags, then templates
    c = _c(c)
    no_tags = _guarded(c, "<", F.regexp_replace(c, RE_TAG, ""))
    return F.when(no_tags.contains("{{"), F.regexp_replace(no_tags, RE_TEMPLATE, "")).otherwise(no_tags)


def trim_punct(c: ColumnOrName) -> Column:  # X10
    return F.btrim(_c(c), F.lit(EDGE_PUNCT))


def drop_year_range(c: ColumnOrName) -> Column:  # X11
    c = _c(c)
    return pystrip(_guarded(c, "(", F.regexp_replace(c, RE_YEAR_RANGE, "")))


def cut_top_level(c: ColumnOrName) -> Column:  # X12
    """Cut at the first comma/period outside parentheses, then strip."""
    return apply_cut(c, cut_index(c))


def apply_cut(c: ColumnOrName, cut: ColumnOrName) -> Column:
    s, k = _c(c), _c(cut)
    return F.when(s.isNull(), s).when(k >= 0, pystrip(F.substring(s, F.lit(1), k))).otherwise(s)


# First top-level cut when no '(' occurs (depth stays 0): a comma, or a period
# that does not follow a standalone c/C (one not preceded by a letter).
RE_FLAT_CUT = r"(?s)^(.*?)(?:,|(?<![cC])\.|(?<=\p{L}[cC])\.)"


def cut_index(c: ColumnOrName) -> Column:
    """0-based position of the X12 cut, -1 for none.

    Strings without '(' take one lazy regex; only those with a parenthesis
    need the depth-tracking fold (higher-order functions run interpreted).
    """
    s = _c(c)
    flat = F.when(s.rlike(RE_FLAT_CUT), F.length(F.regexp_extract(s, RE_FLAT_CUT, 1))).otherwise(F.lit(-1))
    return F.when(s.contains("("), cut_index_fold(s)).otherwise(flat)


def cut_index_fold(c: ColumnOrName) -> Column:
    """0-based position of the X12 cut, -1 for none (general fold).

    Depth never drops below 0; a period right after a standalone ``c``
    (circa) is not a cut.  One left fold over the code points; the lambda
    only reads its own accumulator (previous two characters, depth, index),
    so nothing outside it is re-evaluated per character.
    """
    s = _c(c)
    chars = F.regexp_extract_all(s, F.lit(r"(?s)."), 0)

    def step(acc, ch):
        depth, cut, i = acc.getField("depth"), acc.getField("cut"), acc.getField("i")
        prev, prev2 = acc.getField("prev"), acc.getField("prev2")
        circa_dot = (i >= 1) & (F.lower(prev) == "c") & ((i == 1) | ~prev2.rlike(r"^\p{L}$"))
        done = cut >= 0
        new_depth = (
            F.when(done, depth)
            .when(ch == "(", depth + 1)
            .when(ch == ")", F.greatest(F.lit(0), depth - 1))
            .otherwise(depth)
        )
        new_cut = (
            F.when(done, cut)
            .when((ch == ",") & (depth == 0), i)
            .when((ch == ".") & (depth == 0) & ~circa_dot, i)
            .otherwise(F.lit(-1))
        )
        return F.struct(
            new_depth.alias("depth"), new_cut.alias("cut"), (i + 1).alias("i"), ch.alias("prev"), prev.alias("prev2")
        )

    none = F.lit(None).cast("string")
    init = F.struct(
        F.lit(0).alias("depth"), F.lit(-1).alias("cut"), F.lit(0).alias("i"), none.alias("prev"), none.alias("prev2")
    )
    return F.aggregate(chars, init, step).getField("cut")


def has_content(after_name: ColumnOrName) -> Column:
    s = pystrip(_c(after_name))
    return (s != "") & (s != ",")


def page_date(year: ColumnOrName, month: ColumnOrName, day: ColumnOrName) -> Column:  # X14
    """The entry date, NULL when the day does not exist in that month (guarded make_date)."""
    y, m, d = _c(year), _c(month), _c(day)
    first = F.make_date(y, m, F.lit(1))
    ok = d.isNotNull() & (d >= 1) & (d <= F.dayofmonth(F.last_day(first)))
    return F.when(ok, F.make_date(y, m, d))


def entry_code(parsed: Column) -> Column:  # X13
    """First failing check, in the reference's order; 'ok' when none fails."""
    p = parsed
    name, desc = p.getField("name"), p.getField("description")
    return (
        F.when(p.getField("foreign"), F.lit("foreign_only"))
        .when(~p.getField("entry").startswith("[["), F.lit("not_link"))
        .when(~p.getField("link_ok"), F.lit("bad_link"))
        .when(p.getField("article_title").contains(":"), F.lit("colon"))
        .when(F.length(name) < 2, F.lit("short_name"))
        .when((F.length(name) == 2) & ~name.rlike(RE_TWO_LETTER), F.lit("bad_two_letter"))
        .when(~p.getField("content"), F.lit("no_content"))
        .when(desc.isNull() | (F.length(desc) <= 3), F.lit("short_desc"))
        .when(is_one_word(desc), F.lit("one_word"))
        .when(desc.rlike(RE_PUNCT_ONLY), F.lit("punct_only"))
        .when(p.getField("death_date").isNull(), F.lit("invalid_date"))
        .otherwise(F.lit("ok"))
    )


def name_warnings(name: ColumnOrName) -> Column:
    """Warnings that do not reject: 'two_letter', 'one_word_name'."""
    n = _c(name)
    return F.filter(
        F.array(
            F.when((F.length(n) == 2) & n.rlike(RE_TWO_LETTER), F.lit("two_letter")),
            F.when(is_one_word(n), F.lit("one_word_name")),
        ),
        lambda x: x.isNotNull(),
    )


# X15-X17 ---------------------------------------------------------------------


def nationality(parent: ColumnOrName) -> Column:  # X15
    p = _c(parent)
    people = pystrip(F.regexp_extract(p, RE_PEOPLE, 1))
    singular = pystrip(F.regexp_extract(p, RE_SINGULAR, 1))
    plural = F.regexp_extract(p, RE_PLURAL, 1)
    plural_adj = F.when(
        F.lower(plural).endswith("s"), F.substring(plural, F.lit(1), F.length(plural) - 1)
    ).otherwise(plural)
    return (
        F.when(p.isNull() | (p == ""), F.lit(None).cast("string"))
        .when(p.rlike(RE_PEOPLE), people)
        .when(p.rlike(RE_SINGULAR) & ~singular.endswith("s"), singular)
        .when(p.rlike(RE_PLURAL), plural_adj)
    )


def suggest_description(desc: ColumnOrName, parent: ColumnOrName) -> Column:  # X16
    """For a one-word description under a group header: nationality + word,
    or the multi-word description found in the header; else the description."""
    d, p = _c(desc), _c(parent)
    nat = nationality(p)
    one = d.isNotNull() & (d != "") & is_one_word(d) & p.isNotNull() & (p != "")
    return F.when(one & nat.isNotNull(), F.when(word_count(nat) > 1, nat).otherwise(F.concat(nat, F.lit(" "), d))).otherwise(d)


def month_title(year: ColumnOrName, month: ColumnOrName) -> Column:  # X17
    first = F.make_date(_c(year), _c(month), F.lit(1))
    return F.concat(F.lit(MONTH_TITLE_PREFIX), F.date_format(first, "MMMM"), F.lit(" "), _c(year).cast("string"))
