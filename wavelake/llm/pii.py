"""Personal data by candidate boosting, with DataFrame functions only.

Generators propose spans of four kinds with high recall: the base patterns (email, ip, card, phone) and looser forms
(spelled-out addresses, numbers without a plus or with other separators, longer addresses of hosts), which overlap. Boosted
trees score each loose candidate by its format (digits, separators, checks that hold) and its context (words that hint
at its kind or against it, before and after, and the characters beside it). They are fitted once in a session on
generated lines, as no table labels personal data: forms of personal data and forms that only look like it, hints being
given and left out on both sides. Each kind's threshold is calibrated on forms that the trees haven't seen, to a wanted
precision. Base spans that pass their checks stay in any case, unscored; other candidates are added if they reach
their threshold, touch no base span, and touch no candidate that scores higher.

Matches are leftmost and don't overlap within a generator. The patterns are written with possessive quantifiers and
start only where a match can start, so that long runs neither backtrack nor recurse. Places are code points.

Nulls: a null text is empty and has no spans. Whole texts, however long; ties of start go by kind; repeated rows are
handled alike; empty tables give no rows; further columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import trees

KINDS = ("email", "ip", "card", "phone")
#: Share of right ones among the lines that a threshold lets through, on forms not seen in the fit.
PRECISION = 0.98

#: (kind, is it the base form, pattern, a cheaper pattern that every text with a match contains)
GENERATORS = (
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", True, r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9][\x20-]?[0-9]"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++", r"[(\[{]at[)\]}]"),
    ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++", " at [A-Za-z0-9-]+ dot "),
    ("ip", False, r"(?<![0-9.])[0-9]{1,3}+(?:(?: \. |\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9.])", r"[0-9](?: \. |\[\.\]|\(\.\))[0-9]"),
    ("ip", False, r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){2,7}+:?(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?(?![0-9A-Fa-f:])", "[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    ("card", False, r"(?<![0-9._/-])[0-9]{4}(?:([._/])[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9._/-])", "[0-9]{4}[._/][0-9]{4}"),
    ("phone", False, r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("phone", False, r"(?<![0-9+().-])00 ?[1-9][0-9]{0,2}+(?:[ -][0-9]{2,8}+){2,4}+(?![0-9.-])", "00 ?[1-9]"),
)
FEATURES = ("kind", "length", "digits", "separators", "sorts", "luhn", "octets", "hint", "against", "left", "right", "digits_fit", "area", "exchange", "ending", "spelled", "zeros")
#: Words that hint at each kind, and words that hint at none (fixed values).
HINTS = {"email": "mail|contact|write|reach|send|email", "ip": "ip|host|server|address|client|login|from|connection", "card": "card|visa|pay|credit|account|mastercard|charge", "phone": "phone|call|tel|mobile|fax|dial|contact|reach|text|ring"}
AGAINST = "version|release|build|order|serial|total|part|isbn|page|chapter|section|item|model|code|ref|reference|score|time|meet|noon|invoice|ticket|sku|upc|tracking|lot|figure|table|ratio|mac|hash|commit"
#: Last labels of host names that spelled-out addresses mostly have (fixed values).
ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|info|co"

SPAN = "array<struct<s:int,k:int,e:int,x:array<double>>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _between(c: Column, low: int, high: int) -> Column:
    return (c >= low) & (c <= high)


def luhn(number: Column) -> Column:
    """Whether a string of 1 to 19 digits passes the check."""
    back = F.reverse(F.left(number, F.lit(19)))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), lambda i: _doubled(F.coalesce(F.try_to_number(F.substr(back, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)), i))
    return _between(F.length(number), 1, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def octets(c: Column) -> Column:
    """Whether every number between dots is at most 255."""
    short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(F.regexp_replace(c, "[^0-9.]", ""), "\\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.right(p, F.lit(3))), F.lit("9999")).cast("int"), F.lit(999)) <= 255))


def _valid(kind: str, m: Column) -> Column:
    """The base checks."""
    n = digits(m)
    return {"email": F.lit(True), "ip": octets(m), "card": _between(F.length(n), 14, 19) & luhn(n), "phone": _between(F.length(n), 10, 15)}[kind]


def _features(kind: str, before: Column, m: Column, after: Column) -> Column:
    """FEATURES of a match between the text since the match before it and that up to the next."""
    n, flag = digits(m), lambda c: F.when(c, 1.0).otherwise(0.0)
    count = F.length(n)
    near, next_ = F.lower(F.right(before, F.lit(40))), F.lower(F.left(after, F.lit(24)))
    between = F.regexp_replace(m, "[A-Za-z0-9]", "")
    low, high = {"email": (0, 99), "ip": (4, 12), "card": (14, 19), "phone": (10, 15)}[kind]
    word = lambda c, words: c.rlike(f"(?<![a-z])(?:{words})(?![a-z])")
    start = F.when(count > 10, count - 9).otherwise(1)  # a phone number's last ten digits
    return F.array(
        F.lit(float(KINDS.index(kind))),
        F.least(F.length(m), F.lit(99)).cast("double"),
        F.least(count, F.lit(99)).cast("double"),
        F.least(F.length(between), F.lit(99)).cast("double"),
        F.size(F.array_distinct(F.split(between, ""))).cast("double"),
        flag(luhn(n)) if kind == "card" else F.lit(0.0),
        flag(F.when(m.contains("."), octets(m)).otherwise(m.contains("::") | (F.length(between) == 7))) if kind == "ip" else F.lit(0.0),
        flag(word(near, HINTS[kind]) | word(next_, HINTS[kind])),
        flag(word(near, AGAINST)),
        flag(F.right(before, F.lit(1)).rlike("[A-Za-z0-9_#$/=-]")),
        flag(F.left(after, F.lit(1)).rlike("[A-Za-z0-9_%/=-]")),
        flag(_between(count, low, high)),
        flag(F.substr(n, start, F.lit(1)).isin("0", "1")) if kind == "phone" else F.lit(0.0),
        flag(F.substr(n, start + 3, F.lit(1)).isin("0", "1")) if kind == "phone" else F.lit(0.0),
        flag(F.lower(m).rlike(f"[^a-z](?:{ENDINGS})$")) if kind == "email" else F.lit(0.0),
        flag(F.lower(m).rlike("dot")) if kind == "email" else flag(m.contains("::")) if kind == "ip" else F.lit(0.0),
        flag(n.rlike("^0*$|^(.)\\1*$|^0123|^1234")),
    )


def _matches(text: Column, kind: str, base: bool, pattern: str, gate: str) -> Column:
    """array<struct<s, k, e, x>> of a generator's matches; base forms only where their checks hold, and without features."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    k = KINDS.index(kind)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, z):
        s = acc["at"] + F.length(z["p"])
        e = s + F.length(z["m"])
        ok = (_valid(kind, z["m"]) & (F.length(digits(z["m"])) > 0 if kind == "card" else F.lit(True))) if base else F.lit(True)
        x = F.array().cast("array<double>") if base else _features(kind, z["p"], z["m"], F.coalesce(z["n"], F.lit("")))
        item = F.struct(s.cast("int").alias("s"), F.lit(k).alias("k"), e.cast("int").alias("e"), x.alias("x"))
        return F.when(z["m"].isNull(), acc).otherwise(F.struct(e.cast("int").alias("at"), F.when(ok, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out")))

    parts = [pieces.alias("p"), hits.alias("m"), *([] if base else [F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))).alias("n")])]
    found = F.aggregate(F.arrays_zip(*parts), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(SPAN))


def candidates(text: Column, base: bool) -> Column:
    return F.flatten(F.array(*[_matches(text, *g) for g in GENERATORS if g[1] == base]))


def _examples(seed: int, n: int) -> list[tuple[str, int, int]]:
    """Generated lines with one candidate each: (line, is it personal data, number of its form).

    A form is a way to write the candidate; what leads to it (a hint of its kind, a word against it, or neither) is drawn
    apart from the form, so that neither alone tells the answer.
    """
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    name = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuv"), rng.integers(3, 9)))
    pick = lambda *a: a[rng.integers(len(a))]
    octet, area = lambda: str(rng.integers(1, 256)), lambda: str(rng.integers(200, 1000))
    hexes = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))

    def card(sep: str, good: bool) -> str:
        own = pick("4", "5", "3", "6") + d(14)
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, own)))
        own += str(((10 - total % 10) + (0 if good else int(rng.integers(1, 10)))) % 10)
        return sep.join(own[i : i + 4] for i in range(0, 16, 4))

    end = lambda: pick(*ENDINGS.split("|"))
    bad_octets = lambda: [octet(), str(rng.integers(256, 999)), octet(), octet()]
    good = {
        "email": [lambda: f"{name()}[at]{name()}[dot]{end()}", lambda: f"{name()} (at) {name()}.{end()}", lambda: f"{name()}.{name()} [at] {name()} [dot] {end()}", lambda: f"{name()}{d(2)} at {name()} dot {end()}", lambda: f"{name()} {{at}} {name()} {{dot}} {end()}", lambda: f"{name()} at {name()} dot {name()} dot {end()}"],
        "ip": [lambda: " . ".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4)), lambda: ":".join(hexes(4) for _ in range(8)), lambda: f"{hexes(4)}:{hexes(4)}::{hexes(3)}:{hexes(2)}", lambda: "(.)".join(octet() for _ in range(4)), lambda: f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}"],
        "card": [lambda: card(".", True), lambda: card("_", True), lambda: card("/", True)],
        "phone": [lambda: f"({area()}) {area()}-{d(4)}", lambda: f"{area()}-{area()}-{d(4)}", lambda: f"{area()} {area()} {d(4)}", lambda: f"{area()}.{area()}.{d(4)}", lambda: f"00{rng.integers(20, 99)} {d(3)} {d(7)}", lambda: f"00 {rng.integers(20, 99)} {d(2)} {d(4)} {d(4)}"],
    }
    bad = {
        "email": [lambda: f"{name()} (at) {name()}.{name().capitalize()}", lambda: f"{name()} [at] {d(2)}.{d(2)}", lambda: f"{name()} at {name()} dot {d(1)}", lambda: f"{name()} at {name()} dot {name()}", lambda: f"{name()} (at) {name()}. {name()}", lambda: f"{d(1)} (at) {d(1)}.{d(2)}"],
        "ip": [lambda: " . ".join(bad_octets()), lambda: "[.]".join(bad_octets()), lambda: f"{rng.integers(0, 24):02}:{rng.integers(0, 60):02}:{rng.integers(0, 60):02}", lambda: ":".join(hexes(2) for _ in range(6)), lambda: f"{rng.integers(1, 9)}:{rng.integers(1, 9)}:{rng.integers(1, 9)}", lambda: "(.)".join(bad_octets())],
        "card": [lambda: card(".", False), lambda: card("_", False), lambda: card("/", False)],
        "phone": [lambda: f"{pick('0', '1')}{d(2)} {d(3)} {d(4)}", lambda: f"{d(3)}-{pick('0', '1')}{d(2)}-{d(4)}", lambda: f"{pick('0', '1')}{d(2)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {pick('0', '1')}{d(2)} {d(4)}", lambda: f"00{d(1)} {pick('00', '01')} {d(2)}", lambda: f"{pick('0', '1')}{d(2)}-{pick('0', '1')}{d(2)}-{d(4)}"],
    }
    out = []
    for _ in range(n):
        kind, right = pick(*KINDS), bool(rng.integers(2))
        forms = (good if right else bad)[kind]
        f = int(rng.integers(len(forms)))
        lead = " ".join(name() for _ in range(rng.integers(1, 5)))
        chance = rng.random()  # words for and against it come with both, but not as often
        hint = pick(*HINTS[kind].split("|")) if chance < (0.55 if right else 0.15) else pick(*AGAINST.split("|")) if chance > (0.97 if right else 0.6) else ""
        joint = pick(" ", ": ", " is ", " me: ", " at: ", " no. ")
        out.append((f"{lead} {hint + joint if hint else ''}{forms[f]()} {name()} {name()}.", int(right), f))
    return out


_MODELS: dict[int, tuple] = {}


def model(spark: SparkSession, seed: int = 11, n: int = 6000) -> tuple[tuple[float, list], tuple[float, ...]]:
    """The trees and each kind's threshold; fitted once in a session, on generated lines of a fixed number. Thresholds are set on the forms, a third of all, that the fit doesn't see, and are 1 where no cut reaches the precision."""
    if seed not in _MODELS:
        lines = _examples(seed, n)
        rows = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(lines)], "i int, text string").coalesce(1)
        got = rows.select("i", F.explode(candidates(F.col("text"), False)).alias("c")).select("i", "c.x").collect()
        i = np.array([r[0] for r in got])
        x, y, form = np.array([r[1] for r in got], float), np.array([lines[k][1] for k in i], float), np.array([lines[k][2] for k in i])
        seen = form % 3 != 2
        fitted = trees.fit(x[seen], y[seen], 30, 4)
        p = trees.sigmoid(fitted[0] + sum(trees.predict(t, x) for t in fitted[1]))
        cuts = []
        for k in range(len(KINDS)):
            own = ~seen & (x[:, 0] == k)
            order = np.argsort(-p[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            enough = np.flatnonzero(right >= PRECISION)
            cuts.append(max(0.5, float(p[own][order][enough[-1]])) if len(enough) else 1.0)
        _MODELS[seed] = fitted, tuple(cuts)
    return _MODELS[seed]


def spans(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra, text, base array<struct<s, k, e>> and spans, the same with those that the trees add; both by start, kind, end."""
    (base_z, grown), cuts = model(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))

    def scored(c):
        p = trees.score((base_z, grown), [F.element_at(c["x"], j + 1) for j in range(len(FEATURES))])
        return F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), p.alias("p"))

    t = F.col("text")
    # texts without a digit, an address sign and a spelled-out one have no candidates, and skip all patterns
    d = d.withColumn("_any", t.rlike("[0-9@]|[(\\[{]at[)\\]}]| at [A-Za-z0-9-]+ dot |::"))
    none, few = F.array().cast(SPAN), F.array().cast("array<struct<s:int,k:int,e:int,p:double>>")
    d = d.withColumn("_b", F.when(F.col("_any"), candidates(t, True)).otherwise(none)).withColumn("_c", F.when(F.col("_any"), candidates(t, False)).otherwise(none))
    touch = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    d = d.withColumn("_p", F.when(F.size("_c") > 0, F.transform(F.filter("_c", lambda c: ~F.exists("_b", lambda b: touch(b, c))), scored)).otherwise(few))
    d = d.withColumn("_p", F.filter("_p", lambda c: c["p"] >= F.element_at(F.array(*[F.lit(v) for v in cuts]), c["k"] + 1)))
    # of candidates that touch, the higher score stays; of equal ones the earlier, then the longer, then the first kind
    better = lambda a, c: F.struct(-a["p"], a["s"], -a["e"], a["k"]) < F.struct(-c["p"], c["s"], -c["e"], c["k"])
    added = F.filter("_p", lambda c: ~F.exists("_p", lambda a: touch(a, c) & better(a, c)))
    d = d.withColumn("_a", F.when(F.size("_p") > 1, added).otherwise(F.col("_p")))
    return d.select("doc_id", *extra, "text", plain("_b").alias("base"), plain(F.concat(F.transform("_b", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))), F.transform("_a", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))).alias("spans"))


def written(spans_: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda c: F.concat_ws(":", F.element_at(names, c["k"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; counts are of base spans."""
    s = spans(docs)
    of = lambda i: lambda c: c["k"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return s.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra and text with each span replaced by its kind in brackets; overlapping spans are covered by the first one's mark."""
    s = spans(docs, extra)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, c):
        gap = F.substr(F.col("text"), acc["at"] + 1, F.greatest(c["s"] - acc["at"], F.lit(0)))
        fresh = F.struct(c["e"].alias("at"), F.concat(acc["out"], F.array(gap, F.element_at(marks, c["k"] + 1))).alias("out"))
        return F.when(c["s"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], c["e"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1, F.length("text") + 1)))
    return s.select("doc_id", *extra, F.when(F.size("spans") > 0, done).otherwise(F.col("text")).alias("text"))
