"""Personal data: base patterns, and candidates chosen by gradient-boosted trees.

Generators propose spans with high recall (grouped and bare digits, numbers without a plus sign,
written-out addresses), overlapping each other and the base spans.  A proposal that equals a
base span is an example of its kind; one that overlaps a base span of any kind without
being one (a part of a number, a number read across its end), or equals a match that the base
check turned down, is a counter-example.  Boosted trees learn
from both by format (digits, groups, signs, check digit) and context (neighbouring characters,
cue words); per kind, the lowest score at which ``precision`` of the examples that the trees did
not see are right is its threshold.  Proposals at or above it are added; base spans always stay.

Only DataFrame functions and the engine's own tree learner are used; the learned trees are
applied as column expressions inside each row, so documents are neither exploded nor shuffled.
The learner sees at most ``examples`` proposals, for each kind the smallest by hash; generators cover
every whole text, and thresholds every example that the learner does not see (a quarter by hash is kept from it).

Defined cases: null text is empty; offsets are code points, end exclusive; with fewer than
``LEAST`` examples or counter-examples nothing is added; repeated rows are judged each; an empty
table gives no rows; other columns are ignored.  Work inside a text grows with its length and its spans (times a
logarithm): offsets are running sums, context comes from short chunks, and proposals meet the base spans in one
sorted pass.  Only additions that overlap one another in one unbroken chain are compared with each other.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowtrace.llm.common import let, pinned

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  Repeats are possessive where nothing after them could
#: take back a character: the same matches without backtracking or recursion on long runs.
#: An address or a number is tried from the start of its run (or where the last match ended): a later
#: start in the run would meet the same end of it, so long runs take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a base pattern holds (of cards: every one long enough to hold or to equal a
#: proposal); the others are not tried.  A guard saves time and never decides what is found.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){7}", "phone": r"\+[0-9]"}
#: Patterns of proposals, each with what its every match holds.
PROPOSED = {
    "email": (
        (r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+", "@"),
        (
            r"(?i)[a-z0-9._%+-]{1,64}+\s?(?:\[at\]|\(at\)|\bat\b)\s?[a-z0-9-]{1,63}+(?:\s?(?:\[dot\]|\(dot\)|\bdot\b|\.)\s?[a-z0-9-]{1,63}+){1,4}+",
            r"(?i)(?:\[at\]|\(at\)|\bat\b)\s?[a-z0-9-]{1,63}+\s?(?:\[dot\]|\(dot\)|\bdot\b|\.)\s?[a-z0-9-]",
        ),
    ),
    "ip": (
        (r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9]|\.[0-9])", r"[0-9]\.[0-9]"),
        (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])", ":[0-9A-Fa-f]{1,4}:"),
        (r"[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+", r"[0-9]\.[0-9]"),
    ),
    "card": (
        (r"(?<![0-9])[0-9]{13,19}+(?![0-9])", "[0-9]{13}"),
        (r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,7}+(?![0-9])", r"[0-9]{4}[\x20-][0-9]{4}"),
        (r"(?<![0-9])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])", r"[0-9]{4}[\x20-][0-9]{6}"),
        (r"[0-9]{8,14}", "[0-9]{8}"),
    ),
    "phone": (
        (r"\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{2,4}+\)?[\x20.-]?[0-9]{2,4}+[\x20.-]?[0-9]{2,4}+(?![0-9])", r"\+[0-9]"),
        (r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
        (r"(?<![0-9])00[0-9]{1,3}[\x20.-]?[0-9][0-9\x20.-]{6,14}[0-9](?![0-9])", "00[0-9]"),
        (r"[0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ),
}
#: Words that announce a kind.
CUES = {"email": "mail|contact|write", "ip": r"\bip\b|address|server|host", "card": "card|visa|credit|pay", "phone": r"phone|call|tel|fax|mobile|cell"}
LEAST = 20
EXAMPLES = 20_000
DIGITS = "[^0-9]"
#: Elements of an array, or characters of a text, that are handled at once; context reaches 40 characters, less than one.
CHUNK = 256


def running(values: Column, op, kind: str) -> Column:
    """values[0], values[0] op values[1], ... of a lambda variable; in chunks, as growing one array by its elements is quadratic."""
    many = f"array<array<{kind}>>"

    def inside(c: Column) -> Column:
        return F.aggregate(F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), F.slice(c, 1, 1), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))

    def joined(parts: Column) -> Column:
        before = inside(F.transform(parts, lambda a: F.element_at(a, -1)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda a, k: F.when(k == 0, a).otherwise(F.transform(a, lambda x: op(F.get(b, k - 1), x))))))

    starts = F.sequence(F.lit(1), F.size(values), F.lit(CHUNK))
    parts = F.when(F.size(values) > 0, F.transform(starts, lambda at: inside(F.slice(values, at, CHUNK)))).otherwise(F.array().cast(many))
    return let(parts, lambda p: F.when(F.size(p) > 0, joined(p)).otherwise(F.array().cast(f"array<{kind}>")))


def total(a: Column, b: Column) -> Column:
    return a + b


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str, guard: Column, order: int) -> Column:
    """array<struct<start,kind,end,found>> of the pattern's matches, left to right, without overlap.

    The pieces between matches and the matches themselves alternate, so running lengths are the offsets.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def placed(found: Column) -> Column:
        both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("piece"), found.alias("found"))
        lengths = F.transform(both, lambda x: F.length(x["piece"]) + F.length(x["found"]))
        span = lambda f, end: F.struct((end - F.length(f)).alias("start"), F.lit(order).alias("kind"), end.alias("end"), f.alias("found"))
        return let(let(lengths, lambda n: running(n, total, "int")), lambda ends: F.transform(found, lambda f, k: span(f, F.get(ends, k))))

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))
    return F.when(guard, hits).otherwise(none)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, DIGITS, "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def octets(found: Column) -> Column:
    """Whether all numbers between dots are at most 255."""
    small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda s: F.when(F.length(s) > 3, F.lit(False)).otherwise(F.coalesce(s.try_cast("int"), F.lit(0)) <= 255))
    return F.forall(F.split(found, r"\."), small)


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return octets(found)
    if kind == "card":
        return let(digits(found), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(found)).between(10, 15)
    return F.lit(True)


def base_matches(text: Column) -> Column:
    """All matches of the base patterns, with whether they hold: struct(start, kind, end, found, holds)."""

    def told(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found"), valid(kind, s["found"]).alias("holds"))

    each = [F.transform(matches(text, BASE[k], text.rlike(GUARD[k]), n), told(k)) for n, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*each))


def _spans(m: Column, holds: bool) -> Column:
    kept = F.filter(m, lambda s: s["holds"] == holds)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found")))


FEATURES = ("kind", "digits", "length", "groups", "plus", "paren", "luhn", "octets", "at", "words", "before", "after", "digit_before", "digit_after", "cue")


def described(chunks: Column, s: Column) -> Column:
    """A proposal with its features (struct of start, kind, end, found, x: array<double>).

    chunks: the text in pieces of CHUNK characters; a place is counted from the text's start only inside its piece.
    """
    number = digits(s["found"])
    part = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    here, there = (F.floor(s[x] / CHUNK).cast("int") for x in ("start", "end"))
    begin = F.greatest(s["start"] - 40, F.lit(0))
    left = F.substring(F.concat(part(here - 1), part(here)), begin - F.greatest(here - 1, F.lit(0)) * CHUNK + 1, F.least(s["start"], F.lit(40)))
    right = F.substring(F.concat(part(there), part(there + 1)), s["end"] - there * CHUNK + 1, F.lit(2))

    def char_class(c: Column) -> Column:
        return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[.@+_:-]"), 4).otherwise(1)

    cue = F.lit(False)
    for n, k in enumerate(KINDS):
        cue = F.when(s["kind"] == n, F.lower(left).rlike(CUES[k])).otherwise(cue)
    values = {
        "kind": s["kind"],
        "digits": F.length(number),
        "length": F.length(s["found"]),
        "groups": F.size(F.regexp_extract_all(s["found"], F.lit("[0-9]+"), F.lit(0))),
        "plus": s["found"].startswith("+"),
        "paren": s["found"].contains("("),
        "luhn": F.when(F.length(number) >= 8, luhn(number)).otherwise(F.lit(False)),
        "octets": (F.size(F.split(s["found"], r"\.")) == 4) & octets(s["found"]),
        "at": s["found"].contains("@"),
        "words": F.size(F.split(s["found"], r"\s")),
        "before": char_class(F.substring(left, -1, 1)),
        "after": char_class(F.substring(right, 1, 1)),
        "digit_before": left.rlike(r"[0-9][\x20().-]?$"),
        "digit_after": right.rlike(r"^[\x20().-]?[0-9]"),
        "cue": cue,
    }
    x = F.array(*[F.coalesce(values[n].cast("double"), F.lit(0.0)) for n in FEATURES])
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found"), x.alias("x"))


def proposals(text: Column) -> Column:
    """The different matches of all proposing patterns with their features, by start, kind and end."""
    each = [matches(text, p, text.rlike(holds), n) for n, k in enumerate(KINDS) for p, holds in PROPOSED[k]]
    once = let(F.sort_array(F.concat(*each)), lambda s: F.filter(s, lambda x, k: ~x.eqNullSafe(F.get(s, k - 1))))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(chunks, lambda c: F.transform(once, lambda s: described(c, s)))


def against(base: Column, failed: Column, proposed: Column) -> Column:
    """``proposed`` with inside (it lies in a base span), cut (it overlaps one), is_base, is_failed (it equals one).

    All three arrays are lambda variables.  Starts of base spans and the bounds of proposals are sorted together; the greatest
    end so far then tells a proposal's start whether a base span reaches its end, and its end whether one reaches its start.
    """
    event = lambda at, kind, end, no: F.struct(at.alias("at"), F.lit(kind).alias("kind"), end.alias("end"), no.alias("no"))
    # at one place: ends of proposals before the base spans that start there, their starts after
    events = F.sort_array(
        F.concat(
            F.transform(proposed, lambda s, k: event(s["end"], 0, F.lit(0), k)),
            F.transform(base, lambda b: event(b["start"], 1, b["end"], F.lit(-1))),
            F.transform(proposed, lambda s, k: event(s["start"], 2, F.lit(0), k)),
        )
    )

    def reached(e: Column) -> Column:
        """For both kinds of bounds, the greatest base end by then, by number of the proposal."""
        ends = let(F.transform(e, lambda x: x["end"]), lambda v: running(v, most, "int"))
        told = lambda m, kind: F.transform(F.array_sort(F.filter(F.transform(e, lambda x, k: F.struct(x["no"].alias("no"), x["kind"].alias("kind"), F.get(m, k).alias("most"))), lambda x: x["kind"] == kind)), lambda x: x["most"])
        return let(ends, lambda m: F.struct(told(m, 0).alias("at_end"), told(m, 2).alias("at_start")))

    def equal() -> Column:
        """By number of the proposal: 0 equal to a base span, 1 to a failed match, 2 to none."""
        row = lambda s, kind, no: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(kind).alias("is"), no.alias("no"))
        rows = F.sort_array(F.concat(F.transform(base, lambda b: row(b, 0, F.lit(-1))), F.transform(failed, lambda b: row(b, 1, F.lit(-1))), F.transform(proposed, lambda s, k: row(s, 2, k))))
        like = lambda a, b: F.coalesce((a["start"] == b["start"]) & (a["kind"] == b["kind"]) & (a["end"] == b["end"]), F.lit(False))
        first = lambda r: F.transform(r, lambda x, k: F.struct(x["no"].alias("no"), F.when(like(F.get(r, k - 1), x), F.get(r, k - 1)["is"]).otherwise(F.lit(2)).alias("is")))
        return let(rows, lambda r: F.transform(F.array_sort(F.filter(first(r), lambda x: x["no"] >= 0)), lambda x: x["is"]))

    def flagged(m: Column, same: Column) -> Column:
        fields = ("start", "kind", "end", "found", "x")
        return F.transform(
            proposed,
            lambda s, k: F.struct(
                *[s[f].alias(f) for f in fields],
                (F.get(m["at_start"], k) >= s["end"]).alias("inside"),
                (F.get(m["at_end"], k) > s["start"]).alias("cut"),
                (F.get(same, k) == 0).alias("is_base"),
                (F.get(same, k) == 1).alias("is_failed"),
            ),
        )

    return let(let(events, reached), lambda m: let(equal(), lambda same: flagged(m, same)))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, proposed (with what the base says of each) of doc_id, text."""
    rows = docs.withColumn("m", base_matches(F.col("text"))).select("doc_id", _spans(F.col("m"), True).alias("base"), _spans(F.col("m"), False).alias("failed"), proposals(F.col("text")).alias("proposed"))
    told = let(F.col("base"), lambda b: let(F.col("failed"), lambda f: let(F.col("proposed"), lambda p: against(b, f, p))))
    return pinned(rows.select("doc_id", "base", told.alias("proposed")), "spans")


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def tree_expression(text: str, x: Column) -> Column:
    """A learned tree, as its printed form gives it, as a column over the features."""
    lines = [(len(a), b) for a, b in re.findall(r"^( *)(.*\S)", text, re.M) if re.match(r"If|Else|Predict", b)]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at][1]
        at += 1
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        k, cut = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
        low = node()
        at += 1  # Else
        high = node()
        return F.when(F.get(x, F.lit(int(k))) <= F.lit(float(cut)), low).otherwise(high)

    return node()


def learn(found: DataFrame, examples: int, precision: float, seed: int):
    """(probability of a proposal's features, threshold by kind), or None with too few examples."""
    p = found.select("doc_id", F.explode(F.filter("proposed", lambda s: s["cut"] | s["is_failed"])).alias("p"))
    p = p.withColumn("label", F.col("p.is_base").cast("double"))
    p = pinned(p.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "p.start", "p.end", "p.kind")), "told")
    kept_out = F.pmod("h", F.lit(4)) == 0
    each = [p.where((F.col("p.kind") == n) & ~kept_out).orderBy("h", "doc_id", "p").limit(examples // len(KINDS)) for n in range(len(KINDS))]
    fit = pinned(reduce(DataFrame.unionAll, each).select("label", "h", F.col("p.kind").alias("of"), *[F.get("p.x", F.lit(n)).alias(name) for n, name in enumerate(FEATURES)]), "examples")
    n, good = fit.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if min(good, n - good) < LEAST:
        return None
    last = {r[0]: r[1] for r in fit.groupBy("of").agg(F.max("h")).collect()}  # KINDS rows
    unseen = kept_out
    for n in range(len(KINDS)):
        unseen = unseen | ((F.col("p.kind") == n) & (F.col("h") > last[n] if n in last else F.lit(True)))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(fit)
    model = GBTClassifier(maxIter=8, maxDepth=4, stepSize=0.3, seed=seed, subsamplingRate=1.0, maxBins=32).fit(vectors)
    trees = [(w, t.toDebugString) for w, t in zip(model.treeWeights, model.trees)]

    def probability(x: Column) -> Column:
        margin = F.lit(0.0)
        for w, t in trees:
            margin = margin + F.lit(float(w)) * tree_expression(t, x)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    scored = p.where(unseen).select(F.col("p.kind").alias("kind"), "label", F.round(probability(F.col("p.x")), 6).alias("score"))
    levels = scored.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    levels = levels.select("kind", "score", (F.sum("good").over(down) / F.sum("n").over(down)).alias("right"))
    best = {r[0]: r[1] for r in levels.where(F.col("right") >= precision).groupBy("kind").agg(F.min("score")).collect()}  # KINDS rows
    return probability, {k: max(0.5, best[n]) if n in best else 2.0 for n, k in enumerate(KINDS)}


def apart(chosen: Column) -> Column:
    """Of overlapping spans of a kind the longest (the first of equals), against those that stay: longest first.

    Spans are sorted by kind and start and cut where none reaches beyond the next; only what hangs together is compared.
    """
    kinds = "array<struct<start:int,kind:int,end:int,found:string>>"
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found"))

    def greedy(group: Column) -> Column:
        ranked = F.transform(group, lambda s: F.struct((s["start"] - s["end"]).alias("shorter"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found")))

        def step(kept: Column, s: Column) -> Column:
            return F.when(F.exists(kept, lambda o: _overlap(o, s)), kept).otherwise(F.concat(kept, F.array(plain(s))))

        return F.aggregate(F.sort_array(ranked), F.array().cast(kinds), step)

    place = lambda s, x: F.shiftleft(s["kind"].cast("long"), 32) + s[x]

    def groups(s: Column) -> Column:
        reach = let(F.transform(s, lambda x: place(x["s"], "end")), lambda v: running(v, most, "bigint"))
        heads = lambda r: F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (place(x["s"], "start") >= F.get(r, k - 1)), k)), lambda k: k.isNotNull())
        cut = lambda h: F.transform(h, lambda at, k: greedy(F.transform(F.slice(s, at + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - at), lambda x: x["s"])))
        return F.flatten(let(let(reach, heads), cut))

    ordered = F.sort_array(F.transform(chosen, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), plain(s).alias("s"))))
    return let(ordered, lambda s: F.when(F.size(s) > 0, groups(s)).otherwise(F.array().cast(kinds)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, precision: float = 0.98, seed: int = 5) -> DataFrame:
    """doc_id, base, added: arrays of struct(start, kind (number in KINDS), end, found), by start, then kind.

    Added spans are proposals at or above their kind's threshold that lie in no base span; of
    overlapping ones of a kind the longest stays (the first of equals).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = spans(rows)
    learned = learn(found, examples, precision, seed)
    if learned is None:
        return found.select("doc_id", "base", F.slice("base", 1, 0).alias("added"))
    probability, cut = learned
    thresholds = F.array(*[F.lit(float(cut[k])) for k in KINDS])
    chosen = F.filter("proposed", lambda s: ~s["inside"] & (probability(s["x"]) >= F.get(thresholds, s["kind"])))
    return found.select("doc_id", "base", F.sort_array(apart(chosen)).alias("added"))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
