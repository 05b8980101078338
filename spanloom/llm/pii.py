"""Operator 8: personal data, by weak supervision, with DataFrame functions only.

Base spans: the leftmost non-overlapping matches of one pattern for each kind that pass the kind's test. They always stay. Wider
patterns give further candidates: addresses and numbers written apart or with marks put in, national phone numbers, and long runs of
letters and digits that may be secrets (a fifth kind, `secret`, which has no base pattern). Labelers vote on every candidate, base
ones too: strict forms, marks, gazetteers (mail domains, issuers, known beginnings of keys), the word before, and what touches it; a
labeler may abstain. Over all documents the votes are counted by kind, base or not, and pattern of votes, a table of fixed size.
Expectation-maximisation on it estimates each labeler's reliability, where it votes, and the candidates' probabilities; these train
the final span classifier, a naive Bayes model of the candidate's form, its neighbours and its votes, from counts weighted by
probability. A candidate that overlaps no base span is added if the classifier gives it `threshold` or more; of added spans, one
that begins inside an earlier one is left out.

Null and empty texts have no spans: zero counts and empty strings. Offsets are code points. Nothing is cut off or sampled; a cue word
counts if it and what parts it from the candidate take at most NEAR characters. Repeated rows give repeated rows, columns beside
doc_id and text are ignored, and an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import save

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Groups repeat possessively: Java matches these by iteration, others by recursion, which a long text takes beyond the stack. A match
#: starts where its first run of signs starts, or where the last match ended, so that a long run is read once and not from each place.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: In a wider address the parts are joined by the sign itself, or by its name in brackets or between spaces.
AT = r"(?:@|\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20|\x20@\x20)"
DOT = r"(?:\.|\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
IP_DOT = r"(?:\x20?[(\[{](?:dot|DOT|\.)[)\]}]\x20?|\x20?\.\x20|\x20\.|\x20(?:dot|DOT)\x20)"
WIDER = {
    "email": rf"(?:(?<![A-Za-z0-9_%+-])|\G)[A-Za-z0-9_%+-]++(?:{DOT}[A-Za-z0-9_%+-]++){{0,4}}+{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "ip": rf"[0-9]{{1,3}}(?:{IP_DOT}[0-9]{{1,3}}){{3}}",
    "card": r"[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){3}",
    "phone": r"\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}",
    "secret": r"[A-Za-z0-9]{20,}",
}
WIDER_NEEDS = {
    "email": rf"{AT}[A-Za-z0-9-]++{DOT}[A-Za-z0-9]",
    "ip": rf"[0-9]{IP_DOT}[0-9]",
    "card": r"[0-9]{4}[\x20._/-]{1,3}[0-9]{4}",
    "phone": r"[0-9]{2,4}\)?[\x20./-]{1,2}\(?[0-9]{2,4}\)?[\x20./-]",
    "secret": r"[A-Za-z0-9]{20}",
}
NEAR = 32
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "mastercard", "payment", "account", "no", "number"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "dial", "contact"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "apikey", "api-key", "bearer", "credential", "auth"),
}
MAIL_ENDS = ("com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
#: First digits of card issuers.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
#: First letters of widely used keys.
KEY_STARTS = r"^(?:AKIA|ASIA|AIza|ghp|gho|glpat|xox[abp]|sk|pk|eyJ)"
LABELERS = ("strict", "form", "gazetteer", "cue", "shape")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|\z)){4}\z")
    size = F.length(_digits(s))
    if kind == "card":
        return F.when(size.between(12, 19), luhn(_digits(s))).otherwise(False)
    return size.between(9, 15)


def _plausible(kind: str, s: Column) -> Column:
    """What a wider match must be to be a candidate at all."""
    return s.rlike(r"[0-9]") & s.rlike(r"[A-Za-z]") if kind == "secret" else F.lit(True)


def running(values: str, add: str = "x + y", zero: str = "0L") -> Column:
    """For each element of an array column, all elements before it added up by an SQL expression of x and y.

    Goes by blocks of about the square root of their number, so that long arrays stay cheap. transform(array(a), s -> ...)[0] names a:
    an expression used inside a lambda would be computed at each of its calls.
    """
    n = f"size({values})"
    block = f"greatest(cast(ceil(sqrt({n})) as int), 1)"
    total = lambda a: f"aggregate({a}, {zero}, (x, y) -> {add})"
    blocks = f"sequence(0, cast(floor(({n} - 1) / {block}) as int))"
    sums = f"transform({blocks}, b -> {total(f'slice({values}, b * {block} + 1, {block})')})"
    starts = f"transform(array({sums}), s -> transform({blocks}, b -> {total('slice(s, 1, b)')}))[0]"
    own = total(f"slice({values}, cast(i div {block} * {block} + 1 as int), i % {block})")
    each = f"aggregate(array(s[cast(i div {block} as int)], {own}), {zero}, (x, y) -> {add})"
    return F.expr(f"if({n} > 0, transform(array({starts}), s -> transform(sequence(0, {n} - 1), i -> {each}))[0], null)")


MOST = "greatest(x, y)"


SPAN = "array<struct<start:bigint,end:bigint,kind:int,text:string,base:boolean,before:string,after:string>>"


def with_matches(d: DataFrame, searches: list[tuple[str, str, str, bool, Column]]) -> DataFrame:
    """Adds for each search (name, pattern, kind, base, needed) a column of its matches with their places: the pieces between them are split off, and lengths summed up. All searches go step by step together, which keeps the plan low."""
    none = F.array().cast(SPAN)
    d = d.withColumns({f"{name}_found": F.when(needed, F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))) for name, pattern, _, _, needed in searches})
    some = {name: F.coalesce(F.size(f"{name}_found"), F.lit(0)) > 0 for name, *_ in searches}
    d = d.withColumns({f"{name}_between": F.when(some[name], F.split("text", pattern, -1)) for name, pattern, *_ in searches})

    def lengths(name: str) -> Column:
        return F.zip_with(f"{name}_found", F.slice(f"{name}_between", 1, F.size(f"{name}_found")), lambda m, p: (F.length(m) + F.length(p)).cast("bigint"))

    d = d.withColumns({f"{name}_lengths": F.when(some[name], lengths(name)) for name, *_ in searches})
    d = d.withColumns({f"{name}_sums": F.when(some[name], running(f"{name}_lengths")) for name, *_ in searches})

    def spans(name: str, kind: str, base: bool) -> Column:
        def span(z: Column, i: Column) -> Column:
            text, left, right = z[f"{name}_found"], F.get(f"{name}_between", i), F.get(f"{name}_between", i + 1)
            start = z[f"{name}_sums"] + F.length(left)
            # The word before a match must end on the match or a sign between: whole pieces are long, so only their ends are looked at.
            word = F.regexp_extract(F.right(F.concat(F.lit(" "), left), F.lit(NEAR)), r"[^\p{L}-]([\p{L}-]+)[^\p{L}\p{N}]*\z", 1)
            near = F.concat(F.right(left, F.lit(1)), F.lit("_"), F.left(right, F.lit(1)))
            return F.struct(start.cast("bigint").alias("start"), (start + F.length(text)).cast("bigint").alias("end"), F.lit(ALL_KINDS.index(kind)).alias("kind"), text.alias("text"), F.lit(base).alias("base"), F.lower(word).alias("before"), near.alias("after"))

        test = _passes if base else _plausible
        return F.filter(F.transform(F.arrays_zip(f"{name}_found", f"{name}_sums"), span), lambda x: test(kind, x["text"]))

    return d.withColumns({name: F.coalesce(F.when(some[name], spans(name, kind, base)), none) for name, _, kind, base, _ in searches})


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, base (spans that pass), more (further candidates that overlap none of them), each ordered by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = documents.select("doc_id", text.alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    base = [(f"base_{k}", BASE[k], k, True, (F.col("text").contains(NEEDS[k]) if NEEDS[k] else F.lit(True)) & (F.lit(True) if k == "email" else F.col("digit"))) for k in KINDS]
    wider = [(f"more_{k}", WIDER[k], k, False, F.col("text").rlike(WIDER_NEEDS[k]) if k == "email" else F.col("digit") & F.col("text").rlike(WIDER_NEEDS[k])) for k in WIDER]
    d = with_matches(d, base + wider)
    ordered = lambda names: F.array_sort(F.concat(*names), _by_start)
    return _without_overlaps(d.select("doc_id", ordered([x[0] for x in base]).alias("base"), ordered([x[0] for x in wider]).alias("more")))


def _without_overlaps(d: DataFrame) -> DataFrame:
    """Drops of `more` what overlaps a span of `base`: in the order of starts, a span that begins before an earlier base span's end, or ends after a later one's start."""
    zero, both = F.lit(0).cast("bigint"), (F.size("base") > 0) & (F.size("more") > 0)
    at = lambda spans: F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), i.alias("i")))
    d = d.withColumn("line", F.when(both, F.sort_array(F.concat(at("base"), at("more")))))
    ends = F.transform("line", lambda x: F.when(x["base"], x["end"]).otherwise(zero))
    starts = F.reverse(F.transform("line", lambda x: F.when(x["base"], -x["start"]).otherwise(-F.lit(1 << 62))))
    d = d.withColumns({"ends": ends, "starts": starts})
    d = d.withColumns({"upto": running("ends", MOST), "next": F.reverse(running("starts", MOST, f"{-(1 << 62)}L"))})
    apart = F.filter(F.arrays_zip("line", "upto", "next"), lambda z: ~z["line"]["base"] & (z["upto"] <= z["line"]["start"]) & (-z["next"] >= z["line"]["end"]))
    more = F.transform(apart, lambda z: F.get("more", z["line"]["i"]))
    return d.select("doc_id", "base", F.when(both, more).otherwise(F.col("more")).alias("more"))


def _by_start(a: Column, b: Column) -> Column:
    x, y = F.struct(a["start"], a["kind"], a["end"]), F.struct(b["start"], b["kind"], b["end"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _vote(yes: Column, no: Column) -> Column:
    """1, 0 or, where the labeler abstains, -1."""
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def votes(span: Column) -> list[Column]:
    """One vote of each labeler on a candidate span."""
    text, digits, kind = span["text"], _digits(span["text"]), span["kind"]
    size = F.length(digits)

    def by_kind(email: Column, ip: Column, card: Column, phone: Column, secret: Column) -> Column:
        return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).when(kind == 3, phone).otherwise(secret)

    abstain, base = F.lit(-1), span["base"]
    end = F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)\z", 1))
    octets = F.regexp_replace(text, r"[^0-9]+", ".").rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|\z)){4}\z")
    named = text.rlike(r"(?i)[(\[{]\x20?(?:at|@|dot|\.)\x20?[)\]}]|\x20dot\x20")
    hexed = text.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")
    date = text.rlike(r"\A(?:[0-9]{1,2}[\x20./-]){2}[0-9]{2,4}\z|\A[12][0-9]{3}[./-][0-9]{2}[./-][0-9]{2}\z")
    quoted = span["after"].rlike(r"""\A["'`]_["'`]\z""")
    strict = by_kind(
        F.when(base, 1).otherwise(abstain),
        _vote(octets, ~octets),
        F.when(luhn(digits), 1).otherwise(0),
        F.when(base, 1).when(size.between(9, 15), -1).otherwise(0),
        F.when(hexed & F.length(text).isin(32, 40, 48, 56, 64, 128), 1).when(text.rlike(r"[a-z]") & text.rlike(r"[A-Z]"), -1).otherwise(0),
    )
    form = by_kind(
        _vote(~text.rlike(r"\x20") | named, ~named),
        _vote(~text.rlike(r"(?:^|[^0-9])0[0-9]"), text.rlike(r"(?:^|[^0-9])0[0-9]")),
        _vote(size.isin(15, 16), size < 13),
        F.when(date, 0).when(text.rlike(r"\A\+|\A\([0-9]{2,4}\)|\A0[0-9]"), 1).otherwise(abstain),
        _vote(quoted, ~quoted),
    )
    listed = by_kind(
        _vote(end.isin(*MAIL_ENDS), ~end.isin(*MAIL_ENDS) & ~base),
        _vote(~digits.rlike(r"\A0") & ~text.rlike(r"\A(?:127|255)[^0-9]"), text.rlike(r"\A(?:0|127|255)[^0-9]")),
        _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        _vote(text.rlike(r"\A\+[1-9]|\A\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9][0-9]{2}[\x20.-][0-9]{4}\z|\A\(?0[1-9]"), size < 9),
        F.when(text.rlike(KEY_STARTS), 1).otherwise(abstain),
    )
    cued = reduce(lambda out, i: out.when(kind == i, span["before"].isin(*CUES[ALL_KINDS[i]])), range(1, 5), F.when(kind == 0, span["before"].isin(*CUES["email"])))
    joined = span["after"].rlike(r"\A[\p{L}\p{N}@/=_-]_|_[\p{L}\p{N}@/=_-]\z")
    return [strict, form, listed, _vote(cued, F.lit(False)), _vote(F.lit(False), joined)]


def features(span: Column) -> list[Column]:
    """Categories of a candidate's form that the final classifier sees beside the votes."""
    size = F.length(_digits(span["text"]))
    marks = F.array_join(F.sort_array(F.array_distinct(F.split(F.regexp_replace(span["text"], r"[\p{L}\p{N}]", ""), ""))), "")
    return [F.concat(F.lit("n"), F.least(size, F.lit(20)).cast("string")), F.concat(F.lit("m"), F.left(marks, F.lit(6))), F.concat(F.lit("c"), (span["before"] != "").cast("string"))]


class SpanModel:
    """prior: log odds by kind and base or not; votes: weight by kind, labeler and vote; forms: weight by kind, feature and value."""

    def __init__(self, prior: dict[tuple[int, bool], float], vote_weight: dict[tuple[int, int, int], float], form_weight: dict[tuple[int, int, str], float]) -> None:
        self.prior, self.vote_weight, self.form_weight = prior, vote_weight, form_weight


#: Labelers that say only yes, or only no: for them it counts whether they vote. Of the others, only votes count.
YES_ONLY, NO_ONLY = 3, 4


def estimate(counts: list[tuple[int, bool, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[tuple[int, bool], float], dict[tuple[int, int, int], float]]:
    """Expectation-maximisation over counts of (kind, base, votes): log odds of each kind, base or not, and of each labeler's vote.

    Starts from the majority vote. Labelers are taken to be better than chance by the counts added to them, so the classes can't
    swap. The table is small, as many rows as there are patterns of votes.
    """
    post = {(k, b, v): (1 + 2 * sum(x == 1 for x in v)) / (2 + 2 * sum(x >= 0 for x in v)) for k, b, v, _ in counts}
    prior: dict[tuple[int, bool], float] = {}
    weight: dict[tuple[int, int, int], float] = {}
    for _ in range(rounds):
        for kind, base in {(k, b) for k, b, _, _ in counts}:
            yes = sum(n * post[k, b, v] for k, b, v, n in counts if (k, b) == (kind, base))
            total = sum(n for k, b, _, n in counts if (k, b) == (kind, base))
            prior[kind, base] = math.log((yes + 1) / (total - yes + 1))
        for kind in {k for k, _, _, _ in counts}:
            own = [(v, n, post[k, b, v]) for k, b, v, n in counts if k == kind]
            for j in range(len(LABELERS)):
                yes, no = ({x: sum(n * (p if side else 1 - p) for v, n, p in own if v[j] == x) for x in (-1, 0, 1)} for side in (True, False))
                weight[kind, j, -1] = 0.0
                if j in (YES_ONLY, NO_ONLY):
                    vote, good, bad = (1, 2.0, 0.5) if j == YES_ONLY else (0, 0.5, 2.0)
                    rate = min(0.4, (yes[vote] + no[vote] + 1) / (sum(yes.values()) + sum(no.values()) + 10))
                    weight[kind, j, vote] = math.log((yes[vote] + 10 * good * rate) / (yes[vote] + yes[-1] + 10)) - math.log((no[vote] + 10 * bad * rate) / (no[vote] + no[-1] + 10))
                    weight[kind, j, 1 - vote] = 0.0
                else:
                    for vote in (0, 1):
                        good, bad = (4, 1) if vote == 1 else (1, 4)
                        weight[kind, j, vote] = math.log((yes[vote] + good) / (yes[0] + yes[1] + 5)) - math.log((no[vote] + bad) / (no[0] + no[1] + 5))
        post = {(k, b, v): _chance(prior[k, b] + sum(weight[k, j, x] for j, x in enumerate(v))) for k, b, v, _ in counts}
    return prior, weight


def _chance(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30, min(30, odds))))


def _weighted(key: list[Column], table: dict[tuple, float]) -> Column:
    """The table's value at a key of columns, 0 where it has none; one map literal."""
    if not table:
        return F.lit(0.0)
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in ("\x1f".join(map(str, k)), float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\x1f", *[k.cast("string") for k in key])), F.lit(0.0))


def fit(spans: DataFrame) -> SpanModel:
    """spans(base, more) of all documents -> the final classifier. Only counts by kind, votes and forms come to the driver."""
    each = spans.where((F.size("base") > 0) | (F.size("more") > 0)).select(F.explode(F.concat("base", "more")).alias("s"))
    cast = each.select(F.col("s.kind").alias("kind"), F.col("s.base").alias("base"), *[v.alias(f"v{j}") for j, v in enumerate(votes(F.col("s")))], *[f.alias(f"f{j}") for j, f in enumerate(features(F.col("s")))])
    names = [f"v{j}" for j in range(len(LABELERS))]
    forms = [f"f{j}" for j in range(3)]
    # Forms have a bounded number of values: at most 20 sizes, short sets of marks, and two neighbours.
    rows = cast.groupBy("kind", "base", *names, *forms).count().collect()
    patterns: dict[tuple[int, bool, tuple[int, ...]], int] = {}
    for r in rows:
        at = (r.kind, r.base, tuple(r[n] for n in names))
        patterns[at] = patterns.get(at, 0) + r["count"]
    prior, weight = estimate([(*at, n) for at, n in sorted(patterns.items())])
    sums: dict[tuple, list[float]] = {}
    totals: dict[int, list[float]] = {}
    for r in rows:
        p = _chance(prior[r.kind, r.base] + sum(weight[r.kind, j, r[n]] for j, n in enumerate(names)))
        for place, q in enumerate((1 - p, p)):
            totals.setdefault(r.kind, [0.0, 0.0])[place] += q * r["count"]
            for j, n in enumerate(forms):
                sums.setdefault((r.kind, j, r[n]), [0.0, 0.0])[place] += q * r["count"]
    form_weight = {(k, j, x): math.log((b + 1) / (totals[k][1] + 2)) - math.log((a + 1) / (totals[k][0] + 2)) for (k, j, x), (a, b) in sums.items()}
    return SpanModel(prior, weight, {k: 0.3 * v for k, v in form_weight.items()})


def accepted(span: Column, model: SpanModel, threshold: float) -> Column:
    """Whether the final classifier takes a candidate for personal data."""
    score = _weighted([span["kind"], span["base"]], {(k, str(b).lower()): v for (k, b), v in model.prior.items()})
    for j, v in enumerate(votes(span)):
        score = score + _weighted([span["kind"], F.lit(j), v], {k: w for k, w in model.vote_weight.items() if k[1] == j})
    for j, f in enumerate(features(span)):
        score = score + _weighted([span["kind"], F.lit(j), f], {k: w for k, w in model.form_weight.items() if k[1] == j})
    return score >= math.log(threshold / (1 - threshold))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(documents: DataFrame, threshold: float = 0.9) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. One row for each document, no shuffle of texts."""
    found = save(candidates(documents), "candidates")
    model = fit(found)
    whole = found.withColumn("taken", F.when(F.size("more") > 0, F.filter("more", lambda x: accepted(x, model, threshold))).otherwise(F.col("more")))
    ends = F.transform("taken", lambda x: x["end"])
    whole = whole.withColumn("ends", F.when(F.size("taken") > 1, ends)).withColumn("upto", running("ends", MOST))
    single = F.transform(F.filter(F.arrays_zip("taken", "upto"), lambda z: z["upto"] <= z["taken"]["start"]), lambda z: z["taken"])
    whole = whole.withColumn("added", F.when(F.size("taken") > 1, single).otherwise(F.col("taken")))
    whole = whole.withColumn("all", F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"), _by_start)).otherwise(F.col("base")))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return whole.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
