"""Page parsing: entry goldens and line-state goldens (FIXTURES section 3), and
the line-state windows on generated pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from knowtrace.operators import wikitext as W

LINES = {
    "plain": "* [[Ada Example]], 73, Danish chess player, cancer.",
    "piped": "* [[Ada Example (artist)|Ada Example]], 73–74, Danish painter.",
    "no_age": "* [[Bo Example]], Danish painter",
    "circa": "* [[Bo Example]], {{circa}} 73, Danish painter",
    "decade": "* [[Bo Example]], 60s, Danish painter (oils, ink), cancer",
    "ill": "* {{ill|Bo Example|da}}, 73, [[Danish]] painter",
    "comment": "* <!--D-->[[Bo Example]], 40, Danish painter",
    "comment_space": "* <!--D--> [[Bo Example]], 40, Danish painter",
    "file": "* [[File:Bo.jpg]], 40, Danish painter",
    "two": "* [[Al]], 40, Danish painter",
    "two_bad": "* [[AL]], 40, Danish painter",
    "empty": "* [[Bo Example]],",
    "abbrev": "* [[Bo Example]], 40, U.S. senator",
    "one_word": "* [[Bo Example]], 40, singer",
    "text": "* plain text, 40, Danish painter",
}


def _pages(spark, pages):
    rows = [(pid, 2024, 11, text) for pid, text in pages.items()]
    return spark.createDataFrame(rows, "page_id string, year int, month int, text string")


@pytest.fixture(scope="module")
def golden(spark):
    text = "==1==\n" + "\n".join(LINES.values()) + "\n==31==\n* [[Late Example]], 40, Danish painter"
    parsed = W.parse_all(_pages(spark, {"p": text}))
    return {r.line: r for r in parsed.collect()}


def test_entry_goldens(golden):
    g = lambda k: golden[LINES[k]]
    assert (g("plain").name, g("plain").article_title, g("plain").description) == (
        "Ada Example",
        "Ada Example",
        "Danish chess player",
    )
    assert (g("piped").article_title, g("piped").name, g("piped").description) == (
        "Ada Example (artist)",
        "Ada Example",
        "Danish painter",
    )
    assert g("no_age").code == "ok" and g("no_age").description == "Danish painter"
    assert g("circa").description == "c. 73"  # kept quirk D4
    assert g("decade").description == "Danish painter (oils, ink)"
    assert g("ill").code == "foreign_only"
    assert g("comment").code == "ok"
    assert g("comment_space").code == "not_link"
    assert g("file").code == "colon"
    assert g("two").code == "ok" and list(g("two").warnings) == ["two_letter", "one_word_name"]
    assert g("two_bad").code == "bad_two_letter"
    assert g("empty").code == "no_content"
    assert g("abbrev").code == "short_desc" and g("abbrev").parsed_description == "U"
    assert g("one_word").code == "one_word"
    assert LINES["text"] not in golden
    late = golden["* [[Late Example]], 40, Danish painter"]
    assert late.code == "invalid_date"
    assert str(g("plain").death_date) == "2024-11-01"


def test_line_state_goldens(spark):
    pages = {
        "group": "==1==\n* Notable Danes killed in the X crash:\n** [[Bo Example]], 40, singer",
        "blank": "==1==\n* Notable Danes killed in the X crash:\n\n** [[Bo Example]], 40, singer",
        "people": "==1==\n* Danish people killed in the X attack\n** [[Bo Example]], 40, singer",
        "single": "==1==\n* Danish marathon runner killed in the X race\n** [[Bo Example]], 40, athlete",
        "before": "* [[Bo Example]], 40, Danish painter\n==1==",
        "notes": "== Notes ==\n==1==\n* [[Bo Example]], 40, Danish painter",
        "foo": "==1==\n==Foo==\n* [[Bo Example]], 40, Danish painter",
        "lone": "==1==\n*\n* [[Bo Example]], 40, Danish painter",
    }
    got = {}
    for r in W.parse_all(_pages(spark, pages)).collect():
        got.setdefault(r.page_id, []).append(r)
    g = got["group"]
    assert len(g) == 1 and g[0].code == "one_word"
    assert g[0].parent_item == "* Notable Danes killed in the X crash:" and g[0].suggested_description == "Dane singer"
    assert got["blank"][0].parent_item is None and got["blank"][0].suggested_description == "singer"
    assert got["people"][0].suggested_description == "Danish singer"
    assert got["single"][0].suggested_description == "Danish marathon runner"
    assert "before" not in got and "notes" not in got
    assert got["foo"][0].day == 1 and got["foo"][0].code == "ok"
    assert len(got["lone"]) == 1


def _page(rnd):
    """A page and, from how it was built, the (line, day, parent) of each line to be parsed."""
    lines, expected = ["* [[Too Early]], 40, x y"], set()
    for day in sorted(rnd.sample(range(1, 29), rnd.randint(1, 4))):
        lines.append(rnd.choice(["==%d==", "=== %d ===", "== %d =="]) % day)
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.choice(["entry", "group", "orphan", "plain", "other"])
            if kind == "entry":
                lines.append("* [[A B]], 40, x y")
                expected.add((len(lines), day, None))
                lines.append("text")
            elif kind == "group":
                head = rnd.choice(["* group header", "* [[Link]] header"])
                lines.append(head)
                lines += rnd.choice([[], [], ["", "  "]])
                apart = lines[-1] != head
                for k in range(rnd.randint(1, 3)):
                    lines.append(rnd.choice(["** [[C D]], 41, p q", "*** [[E F]], 1, a b"]))
                    expected.add((len(lines), day, None if apart else head))
                lines.append("text")
            elif kind == "orphan":
                lines += ["text", "** [[C D]], 41, p q"]
                expected.add((len(lines), day, None))
                lines.append("text")
            elif kind == "plain":
                lines += ["* plain", "** no link", "text"]
            else:
                lines += ["==Foo==", "*", ""]
    if rnd.random() < 0.5:
        lines += ["== See also ==", "==9==", "* [[Too Late]], 40, x y"]
    return "\n".join(lines), expected


def test_line_state_of_generated_pages(spark):
    rnd = random.Random(7)
    built = {f"p{k}": _page(rnd) for k in range(300)}
    got = {}
    for r in W.page_lines(_pages(spark, {k: text for k, (text, _) in built.items()})).collect():
        got.setdefault(r.page_id, set()).add((r.line_no, r.day, r.parent_item))
    for pid, (_, expected) in built.items():
        assert got.get(pid, set()) == expected, pid


def test_corrections(spark):
    text = "==1==\n* [[Bo Example]], 40, singer\n* [[File:Bo.jpg]], 40, Danish painter\n* [[Cy Example]], 40, poet"
    ent, rej = W.parse_pages(_pages(spark, {"p": text}))
    fixes = spark.createDataFrame(
        [("p", 2, "fix", "", ""), ("p", 3, "fix", "Bo", "Danish painter"), ("p", 4, "skip", "", "")],
        "page_id string, line_no int, action string, name string, description string",
    )
    got = {r.name: r for r in W.apply_corrections(rej, fixes).collect()}
    assert set(got) == {"Bo Example", "Bo"}
    assert got["Bo Example"].description == "singer" and got["Bo"].article_title == "Bo"


def test_month_title_and_pages(spark):
    months = W.month_starts(spark, "2024-01-15", "2024-03-01")
    assert [(r.year, r.month) for r in months.orderBy("month_start").collect()] == [(2024, 1), (2024, 2), (2024, 3)]
    pages = spark.createDataFrame(
        [("Deaths in February 2024", "x"), ("Deaths in May 2024", "y")], "title string, text string"
    )
    assert [r.title for r in W.month_pages(pages, months).collect()] == ["Deaths in February 2024"]
    with pytest.raises(ValueError):
        W.month_starts(spark, "2024-03-01", "2024-01-01")
    t = spark.range(1).select(F.lit(1).alias("x"))
    assert t.count() == 1


ENTRIES = [
    ("* [[Bo Example]], 40, Danish painter [http://x.example a, b]", "ok", "Danish painter"),
    ("* [[Bo Example]], {{circa}} 73, Danish painter", "ok", "c. 73"),
    ("* [[Bo Example]], 40, Danish <b>painter</b>", "ok", "Danish painter"),
    ("* [[Bo Example]], 40, Danish {{x|y}}painter", "ok", "Danish painter"),
    ("* [[Bo Example]], 40, Danish painter (1984–2024)", "ok", "Danish painter"),
    ("* {{ill|Bo Example|da}}, 73, [[Danish]] painter", "foreign_only", None),
    ("* Bo [[Danish]], 40, Danish painter", "not_link", None),
    ("* [[Bo Example, 40, Danish painter", "bad_link", None),
    ("* [[File:Bo.jpg]], 40, Danish painter", "colon", None),
    ("* [[B]], 40, Danish painter", "short_name", None),
    ("* [[AL]], 40, Danish painter", "bad_two_letter", None),
    ("* [[Bo Example]],", "no_content", None),
    ("* [[Bo Example]], 40, U.S. senator", "short_desc", None),
    ("* [[Bo Example]], 40, singer", "one_word", None),
    ("* [[Bo Example]], 40, - : - :: -", "punct_only", None),
]


def test_every_entry_code(spark):
    page = "==1==\n" + "\n".join(x for x, _, _ in ENTRIES) + "\n==31==\n* [[Bo Example]], 40, Danish painter"
    pages = spark.createDataFrame([("p", 2024, 2, page)], "page_id string, year int, month int, text string")
    got = {r.line_no: (r.code, r.description if r.code == "ok" else None) for r in W.parse_all(pages).collect()}
    want = {n + 2: (code, desc) for n, (_, code, desc) in enumerate(ENTRIES)}
    assert got == {**want, len(ENTRIES) + 3: ("invalid_date", None)}


def test_circa_ages_can_be_read(spark):
    text = "==1==\n" + "\n".join([LINES["circa"], LINES["plain"], "* [[Cy Example]], c. 60s, Danish actor", "* [[Di Example]], c. painter, Danish"])
    got = {r.name: r.description for r in W.parse_all(_pages(spark, {"p": text}), fix_circa=True).collect()}
    assert got == {"Bo Example": "Danish painter", "Ada Example": "Danish chess player", "Cy Example": "Danish actor", "Di Example": "c. painter"}


def test_rejects_by_page(spark):
    pages = _pages(spark, {"p": "==1==\n" + "\n".join([LINES["ill"], LINES["file"], LINES["plain"]]), "q": "==2==\n" + LINES["empty"], "r": "==3==\n" + LINES["plain"]})
    _, rejects = W.parse_pages(pages)
    assert {r.page_id: r.errors for r in W.reject_summary_by_page(rejects).collect()} == {"p": 2, "q": 1}  # the foreign one counts


def test_no_line_is_sorted(spark):
    """A window over the lines sorted all that a task read: its memory grew with the pages, not with a page."""
    pages = _pages(spark, {"p": "==1==\n" + "\n".join(LINES.values())})
    for df in (W.page_lines(pages), *W.parse_pages(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan, plan


ODD_LINES = {  # lines between a group header and its sub-item, and whether the header stays a group
    "": False, " ": False, "\r": False, "\u3000": False, "\x1c": False, "12:": None, "text": None, "==Foo==": None, "==٣==": None, "==123==": None, "** plain": True,
}


def test_lines_between_a_header_and_its_item(spark):
    pages = {repr(x): f"==1==\n* [[H]] group\n{x}\n** [[B C]], 40, p q\n==\tNOTES==\n* [[Z]] no" for x in ODD_LINES}
    got = {k: set() for k in pages}
    for r in W.page_lines(_pages(spark, pages)).collect():
        got[r.page_id].add((r.line_no, r.day, r.parent_item, r.is_sub))
    for x, group in ODD_LINES.items():
        head = {(2, 1, None, False)} if group is None else set()  # a header without sub-items is an entry itself
        assert got[repr(x)] == {*head, (4, 1, "* [[H]] group" if group else None, True)}, x


def test_a_page_with_the_id_of_another(spark):
    rows = [("p", 2024, 11, "==1==\n* [[A B]], 40, x y"), ("p", 2024, 11, "==2==\ntext\n* [[C D]], 40, x y"), (None, 2024, 11, None)]
    pages = spark.createDataFrame(rows, "page_id string, year int, month int, text string")
    assert sorted((r.line_no, r.day) for r in W.page_lines(pages).collect()) == [(2, 1), (3, 2)]
