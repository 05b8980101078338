"""Edited answers: leaves of a tool response tagged in an answer, tags led back to leaves, values located without doubt, deletions within a
budget, and the spans of an answer that an edit leaves without ground.

All is row by row, on arrays of the row's own leaves, tags and spans, so nothing here shuffles. What has to read a whole text for many
values at once (tagging, finding) does so once for each row, in Arrow batches, by an automaton over all values if they are many; the rest
is expressions. Leaves are made, located and compared in the same pass over a row's texts, so that they needn't go to and fro.
Case is folded place by place, so that offsets hold: characters whose lower case is longer stay as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal
from math import isfinite

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import json_tree
from spanloom.functions.json_tree import LEAF, leaf_list, with_columns
from spanloom.functions.text import bound
from spanloom.operators import spans
from spanloom.operators.examples import CURRENCIES, apart, key_spans

NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?")
#: Up to so many values are looked for one by one: an automaton would take longer to build.
FEW = 64

#: Names of the two kinds of change, and headings of their notes.
CONFLICT, BASELESS = "Evident Conflict", "Evident Baseless Info"


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def places(text: str, wanted: set[str]) -> dict[str, list[int]]:
    """Where each of some texts begins in a text, in order, overlapping places too; both given in lower case. One pass over the text, if they are more than a few."""
    wanted = {w for w in wanted if w}
    found: dict[str, list[int]] = defaultdict(list)
    if len(wanted) <= FEW:
        found.update((w, at) for w in wanted if (at := places_of(text, w)))
    elif text:
        automaton = ahocorasick.Automaton()
        for w in wanted:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for end, w in automaton.iter(text):
            found[w].append(end + 1 - len(w))
    return found


def places_of(text: str, part: str) -> list[int]:
    """Where a text begins in another, in order, overlapping places too."""
    found, at = [], text.find(part)
    while at >= 0:
        found.append(at)
        at = text.find(part, at + 1)
    return found


def found_in(rows: DataFrame, text: str, wanted: str, into: str) -> DataFrame:
    """rows with into: map of each of the wanted texts (an array column) that occur, in any case, to the array of its places. Keys are lower case."""

    def one(t: str | None, w: list[str | None] | None) -> tuple:
        return (list(places(lowered(t or ""), {lowered(x) for x in w or () if x}).items()),)

    return with_columns(rows, {into: "map<string,array<int>>"}, [text, wanted], one)


# Tagging


def _tagged(answer: str | None, leaves: list[tuple[str, str, str, str]] | None) -> tuple:
    """Longest values first, each at its first place that is still free. Values are handled in falling length, so a taken stretch that overlaps a place covers one of its ends."""
    text = answer or ""
    low = lowered(text)
    values = [(i, names, v, lowered(v)) for i, (_, names, kind, value) in enumerate(leaves or ()) if kind != "null" and (v := value.lower() if kind == "boolean" else value).strip()]
    values.sort(key=lambda x: -len(x[2]))
    keys = {x[3] for x in values}
    at = places(low, keys) if len(keys) > FEW else None  # few values are looked for place by place, as far as it takes
    reached: dict[str, int] = {}  # of each value, its last place looked at, -1 if there is none left, or, with at, that place's number
    until = [0] * (len(text) + 1)  # the end of the taken stretch over each place
    taken, held = [], set()
    for i, names, value, key in values:
        size = len(value)
        if at is None:
            if (start := reached.get(key, 0)) >= 0:
                start = low.find(key, start)
                while start >= 0 and (until[start] or until[start + size - 1]):
                    start = low.find(key, start + 1)
                reached[key] = start
        else:
            starts, n = at.get(key, ()), reached.get(key, 0)
            while n < len(starts) and (until[starts[n]] or until[starts[n] + size - 1]):
                n += 1
            reached[key], start = n, starts[n] if n < len(starts) else -1
        if start >= 0:
            until[start : start + size] = [start + size] * size
            taken.append((start, start + size, names.rpartition(".")[2], i))
            held.add(key)
    taken.sort()
    pieces, last = [], 0
    for start, end, name, _ in taken:
        pieces += [text[last:start], f"[{name}]{text[start:end]}[/{name}]"]
        last = end
    held |= {key for key in keys - held if any(until[s] >= s + len(key) for s in (places_of(low, key) if at is None else at.get(key, ())))}
    return "".join([*pieces, text[last:]]), len(taken), [n for _, n, _, key in values if key not in held], taken


def tag_answers(rows: DataFrame, response: str, answer: str, tags: bool = True) -> DataFrame:
    """rows(response: JSON, answer, ...) -> with tagged_answer ([key]value[/key]), num_tags, num_unmatched, unmatched_keys and tags (start and end in the answer, key, leaf: its number).

    A leaf's key is its last object key; list places don't count. Nulls and blank values have no tag; true and false are looked for in
    any case. A leaf is unmatched if its value stands in no tag, not even as a part. A response that is no JSON has no leaves; a null
    answer counts as empty. Without tags, that column isn't made.
    """
    new = {"tagged_answer": "string", "num_tags": "int", "unmatched_keys": "array<string>"} | ({"tags": "array<struct<start:int,end:int,key:string,leaf:int>>"} if tags else {})
    d = with_columns(rows, new, [answer, response], lambda a, r: _tagged(a, leaf_list(r))[: len(new)])
    return d.withColumn("num_unmatched", F.size("unmatched_keys"))


def tag_where_missing(rows: DataFrame, response: str, answer: str, tagged: str = "tagged_answer", overwrite: bool = False) -> DataFrame:
    """rows whose tagged answer is null or empty get one (with overwrite: all); the others keep theirs."""
    made = tag_answers(rows.withColumnRenamed(tagged, "_had"), response, answer)
    kept = F.lit(not overwrite) & (F.coalesce(F.length("_had"), F.lit(0)) > 0)
    return made.withColumn(tagged, F.when(kept, F.col("_had")).otherwise(F.col("tagged_answer"))).drop("_had")


def _paths(tags: list[tuple[str, str]], leaves: list[tuple[str, str]]) -> list[str | None]:
    """Of tags as (key, value) the paths, from leaves as (path, value). Each key has a cursor in its own leaves; a tag takes the first leaf from there on whose value is like its own, or else the one at the cursor."""
    by_key = defaultdict(list)
    for path, value in leaves:
        by_key[path.rpartition(".")[2]].append((path, value))
    cursor: dict[str, int] = defaultdict(int)
    out = []
    for key, t in tags:
        own, at = by_key[key], cursor[key]
        hit = next((j for j in range(at, len(own)) if own[j][1] in t or t in own[j][1]), at if at < len(own) else None)
        if hit is not None:
            cursor[key] = hit + 1
        out.append(None if hit is None else own[hit][0])
    return out


def _pairs(rows: DataFrame, column: str, *names: str) -> Callable[[list[tuple] | None], list[tuple[str, str]]]:
    """Takes two fields out of the structs of an array column."""
    a, b = map(rows.schema[column].dataType.elementType.fieldNames().index, names)
    return lambda found: [(x[a], x[b]) for x in found or ()]


def _values(leaves: list[tuple[str, str, str, str]] | None, field: int = 0) -> list[tuple[str, str]]:
    """(path or another field, value) of leaves."""
    return [(x[field], x[3]) for x in leaves or ()]


def response_paths(rows: DataFrame, tags: str, response: str, into: str) -> DataFrame:
    """tag_paths over the leaves of a response, which stay in Python."""
    named = _pairs(rows, tags, "key", "value")
    return with_columns(rows, {into: "array<string>"}, [tags, response], lambda t, r: (_paths(named(t), _values(leaf_list(r))),))


def tag_paths(rows: DataFrame, tags: str, leaves: str, into: str) -> DataFrame:
    """rows(tags: array of struct(key, value, ...), leaves: as printed) -> with into: array of the leaf path that each tag stands for, null where its key has no leaf left. Tags of one key go through its leaves in order, each leaf once."""
    named, placed = _pairs(rows, tags, "key", "value"), _pairs(rows, leaves, "path", "value")
    return with_columns(rows, {into: "array<string>"}, [tags, leaves], lambda t, x: (_paths(named(t), placed(x)),))


# Locating


def grouped(whole: Column) -> Column:
    """A whole number's text with commas; null for any other text."""
    return F.when(whole.rlike(r"\A[+-]?[0-9]{1,18}\z"), F.format_number(whole.try_cast("bigint"), 0))


def number_forms(value: str) -> Iterator[str]:
    """Other ways to write a number, in the order of preference: whole, with commas, each of these and the number itself behind a currency sign, as a percentage. None for what is no plain number."""
    if not NUMBER.fullmatch(value):
        return
    number = float(value)
    whole = int(number) if abs(number) < 1e18 and number == int(number) else None
    exact = number if abs(number) < 1e15 else Decimal(repr(number))  # beyond, the digits that tell it from other doubles, then zeros
    commas = f"{exact:,.2f}".rstrip("0").rstrip(".") if isfinite(number) else "-∞" if number < 0 else "∞"
    plain = [] if whole is None else [str(whole)]
    plain += [commas] if commas != value else []
    plain += [] if whole is None else [f"{whole:,}"]
    yield from plain
    for sign in CURRENCIES:
        for form in (*plain, value):
            yield sign + form
    yield value + "%"
    yield value + " %"


def apart_count(starts: list[int], size: int) -> int:
    """How many of some places, in order, don't overlap the one counted before."""
    n = until = 0
    for s in starts:
        if s >= until:
            n, until = n + 1, s + size
    return n


def lower_case(c: Column) -> Column:
    """Lower case of the same length, as lowered()."""
    return F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.lower(x)) == 1, F.lower(x)).otherwise(x)), ""))


#: How often a leaf stands in an answer, and its first place.
SPOT = "struct<n:int,start:int,end:int>"


def _spots(answer: str | None, leaves: list[tuple[str, str]]) -> list[tuple[int, int | None, int | None]]:
    """Of each leaf, given as (kind, value), (n, start, end). All values are looked for in one pass; only those that aren't there are tried in their other forms."""
    low = lowered(answer or "")
    # A value itself may be short only if a form of it isn't; a value under 3 characters is never looked for.
    values = [v if kind != "null" and len(v := value.strip(" ")) >= 3 else None for kind, value in leaves]
    keys = [None if v is None else lowered(v) for v in values]
    if len(keys) > FEW:
        at = places(low, {lowered(f) for v in values if v is not None for f in (v, *number_forms(v))})
        look = lambda k: at.get(k, [])
    else:
        look = lambda k: places_of(low, k)
    out = []
    for value, key in zip(values, keys, strict=True):
        form, found = value, [] if value is None else look(key)
        if value is not None and not found:
            form, found = next(((f, x) for f in number_forms(value) if len(f) >= 3 and (x := look(lowered(f)))), (value, []))
        out.append((apart_count(found, len(form)), found[0], found[0] + len(form)) if found else (0, None, None))
    return out


def spots(rows: DataFrame, answer: str, leaves: str, into: str) -> DataFrame:
    """rows with into: array of struct(n, start, end), one for each leaf: how often its value stands in the answer, or, where it doesn't and is a number, the first of number_forms that does; and its first place. n is 0 for nulls, for values shorter than 3 and for absent ones."""
    named = _pairs(rows, leaves, "kind", "value")
    return with_columns(rows, {into: f"array<{SPOT}>"}, [answer, leaves], lambda a, x: (None if x is None else _spots(a, named(x)),))


def placed_leaves(rows: DataFrame, response: str, answer: str, leaves: str, into: str) -> DataFrame:
    """rows with the printed leaves of a response (under `results`, or the root) and their spots in the answer, in one pass over both texts."""

    def one(r: str | None, a: str | None) -> tuple:
        found = leaf_list(r, "results")
        return found, None if found is None else _spots(a, _values(found, 2))

    return with_columns(rows, {leaves: f"array<{LEAF}>", into: f"array<{SPOT}>"}, [response, answer], one)


def sure_places(found: Column) -> Column:
    """struct(start, end) of some leaves' spots, in order, without repeats; null if one of them stands more than once: then it is unclear which is meant."""
    single = F.transform(F.filter(found, lambda x: x["n"] == 1), lambda x: F.struct(x["start"], x["end"]))
    return F.when(~F.exists(found, lambda x: x["n"] > 1), F.array_sort(F.array_distinct(single)))


def _empty(kind: str, value: str) -> bool:
    """Whether a leaf, as printed, is false or zero."""
    return kind == "boolean" and value == "False" or kind == "number" and float(value) == 0


def quoted_paths(rows: DataFrame, response: str, answer: str, into: str) -> DataFrame:
    """rows with into: array of the paths of the response's leaves (under `results`, or the root) that stand just once in the answer, in order; none for nulls, false, zeros and values under 3 characters, nor for a response that is no object or list."""

    def one(r: str | None, a: str | None) -> tuple:
        found = leaf_list(r, "results") or ()
        return ([x[0] if x[0].startswith("results") else f"results.{x[0]}" for x, spot in zip(found, _spots(a, _values(found, 2)), strict=True) if spot[0] == 1 and x[0] and not _empty(x[2], x[3])],)

    return with_columns(rows, {into: "array<string>"}, [response, answer], one)


def tagged_deletions(rows: DataFrame, response: str, tagged: str, deleted: str, into: str) -> DataFrame:
    """rows(response, tagged: the answer with tags, deleted: array of paths) -> with into: array of struct(path, tag, span_start, span_end, span_text, original_value): the tags, with their brackets and their places in the tagged answer, that show a deleted value.

    A path's tag is its last part that is no list place (and not `results`); a tag shows a value if one holds the other. Of a deleted list
    or object the value is its leaves' values, one blank between. Paths without anything at them have none.
    """
    kind = "array<struct<path:string,tag:string,span_start:int,span_end:int,span_text:string,original_value:string>>"
    return with_columns(rows, {into: kind}, [response, tagged, deleted], lambda r, t, gone: (_shown(leaf_list(r), t, gone),))


#: A tag in an answer, as examples.key_spans has it, and a list place.
TAG, PLACE = re.compile(r"\[(\w+)\](.*?)\[/\1\]", re.ASCII | re.DOTALL), re.compile(r"[0-9]+")


def _tag_of(path: str) -> str | None:
    """The name under which a path's value is tagged."""
    parts = path.split(".")
    if not PLACE.fullmatch(parts[-1]):
        return parts[-1]
    return next((x for x in reversed(parts) if x != "results" and not PLACE.fullmatch(x)), None)


def _shown(leaves: list[tuple[str, str, str, str]] | None, tagged: str | None, deleted: list[str | None] | None) -> list[tuple] | None:
    wanted = []
    for path in deleted or ():
        values = () if path is None else [x[3] for x in leaves or () if x[0] == path or x[0].startswith(f"{path}.")]
        if values and (tag := _tag_of(path)) is not None:
            wanted.append((path, tag, " ".join(values)))
    if tagged is None:
        return None if wanted else []
    found = [(m[1], m[2], m.start(), m.end(), m[0]) for m in TAG.finditer(tagged)] if wanted else []
    return [(path, tag, start, end, whole, value) for path, tag, value in wanted for key, shown, start, end, whole in found if key == tag and (value in shown or shown in value)]


# Deletions


def _fitting(leaves: list[tuple[str, str, str, str]] | None, found: list[tuple[int, int | None, int | None]] | None, size: int, single: bool) -> list[tuple | None]:
    """For each leaf the deletion that it stands for, if that fits, whatever the order in which leaves are tried: (path, number of its first leaf, of how many, cascade, spans)."""
    total, cut = len(leaves or ()), [x[0].split(".") for x in leaves or ()]
    first: dict[str, int] = {}
    count: dict[str, int] = defaultdict(int)
    for i, parts in enumerate(cut):  # the leaves of one parent stand in a row
        for k in range(len(parts)):
            up = ".".join(parts[:k])
            first.setdefault(up, i)
            count[up] += 1
    deep = max(map(len, cut), default=0) > 1

    def clear(at: int, n: int) -> list[tuple[int, int]] | None:
        """The places of the leaves' values; None if they are too many or one stands more than once."""
        own = found[at : at + n]
        return None if 2 * n > total or any(x[0] > 1 for x in own) else sorted({(s, e) for times, s, e in own if times == 1})

    def fits(s: list[tuple[int, int]] | None) -> bool:
        return bool(s) and (not single or len(s) == 1) and (size == 0 or 2 * sum(e - b for b, e in s) <= size)

    of_parent = {up: clear(first[up], count[up]) for up in {".".join(x[:-1]) for x in cut if len(x) > 1}} if deep else {}
    out: list[tuple | None] = []
    for i, parts in enumerate(cut):
        up = ".".join(parts[:-1])
        whole = of_parent.get(up) if deep and len(parts) > 1 else None
        if fits(whole):
            out.append((up, first[up], count[up], True, whole))
            continue
        alone = clear(i, 1) if not (deep and len(parts) > 1) or whole == [] else None
        out.append((leaves[i][0], i, 1, False, alone) if fits(alone) else None)
    return out


def budgeted_deletions(rows: DataFrame, response: str, answer: str, order: Callable[[Column], Column], single: bool = False) -> DataFrame:
    """rows(response: JSON, answer, ...) -> with deletion: what to delete of the response so that the answer loses its ground in clear places, or null.

    Leaves under `results` (or the root) are tried in the given order of their paths, and the first that fits wins: the parent of the
    leaf goes with all it holds, or the leaf alone in a flat tree; at most half of the leaves go; none of their values stands twice in
    the answer, at least one stands there, and what stands there is at most half of the answer. If a parent's values are all absent, its
    leaf is tried alone. With single, only deletions with one span count. deletion: struct(path, leaves, cascade, spans, n_spans,
    pct_deleted, reduced: the response without it). A tree with one leaf never fits, nor does one that is no JSON.
    """

    def one(r: str | None, a: str | None) -> tuple:
        found = leaf_list(r, "results")
        return found, _fitting(found, _spots(a, _values(found, 2)), len(a or ""), single)

    tried = "array<struct<path:string,at:int,n:int,cascade:boolean,spans:array<struct<start:int,end:int>>>>"
    d = with_columns(rows, {"_leaves": f"array<{LEAF}>", "_tried": tried}, [response, answer], one)
    total, text = F.size("_leaves"), F.coalesce(F.col(answer), F.lit(""))
    fit = F.filter(F.transform("_tried", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: x["x"].isNotNull())
    first = F.array_min(F.transform(fit, lambda x: F.struct(order(F.get("_leaves", x["i"])["path"]).alias("o"), x["i"].alias("i"))))
    d = d.withColumn("_first", first).withColumn("_pick", F.get("_tried", F.col("_first.i")))
    d = d.withColumn("_gone", F.slice("_leaves", F.col("_pick.at") + 1, F.col("_pick.n")))
    prefix = F.when(F.get_json_object(response, "$.results").isNotNull(), "results.").otherwise("")
    d = d.withColumn("_path", F.concat(prefix, F.col("_pick.path"))).withColumn("_reduced", json_tree.delete_path(response, "_path"))
    placed = F.transform("_pick.spans", lambda s: F.struct(s["start"], s["end"], spans.cut(text, s["start"], s["end"]).alias("text")))
    share = F.round(100 * F.col("_pick.n") / total).cast("int")
    out = F.struct(F.col("_path").alias("path"), F.col("_gone").alias("leaves"), F.col("_pick.cascade").alias("cascade"), placed.alias("spans"), F.size("_pick.spans").alias("n_spans"), share.alias("pct_deleted"), F.col("_reduced").alias("reduced"))
    return d.withColumn("deletion", F.when(F.col("_pick").isNotNull(), out)).drop("_leaves", "_tried", "_first", "_pick", "_gone", "_path", "_reduced")


# Spans of edited responses

LABEL = "struct<start:int,end:int,text:string,meta:string,label_type:string,implicit_true:boolean,due_to_null:boolean>"


def label(start: Column, end: Column, text: Column, meta: Column, kind: Column, implicit: bool = False, null: bool = False) -> Column:
    made = F.struct(start.alias("start"), end.alias("end"), text.alias("text"), meta.alias("meta"), kind.alias("label_type"), F.lit(implicit).alias("implicit_true"), F.lit(null).alias("due_to_null"))
    return made.cast(LABEL)


def _changes(before: list[tuple[str, str, str, str]] | None, after: list[tuple[str, str, str, str]] | None) -> list[tuple[str, str, str | None]]:
    """(path, orig, hall) of the leaves that are not as they were."""
    new = {x[0]: x[3] for x in after or ()}
    return [(path, value, new.get(path)) for path, _, _, value in before or () if new.get(path) != value]


def long_values(leaves: list[tuple[str, str, str, str]] | None) -> list[str]:
    """The values of over two characters."""
    return [x[3] for x in leaves or () if len(x[3]) > 2]


def values_of(leaves: list[tuple[str, str, str, str]] | None, paths: list[str | None] | None) -> list[tuple[str, str]]:
    """(path, value) of those paths at which a leaf of over one character stands, in their order."""
    at: dict[str, str] = {}
    for path, _, _, value in leaves or ():
        at.setdefault(path, value)
    return [(p, at[p]) for p in paths or () if len(at.get(p, "")) > 1]


def values_in(text: str | None, paths: list[str | None] | None) -> list[tuple[str, str]]:
    """values_of() of a JSON text's leaves, of which only those at the paths are printed."""
    wanted = {p for p in paths or () if p is not None}
    tree = json_tree.decode(text) if wanted else None
    at: dict[str, str] = {}
    for path, v in () if tree is None else json_tree.walk_plain(tree):
        if path in wanted and path not in at:
            at[path] = json_tree.printed(v)
    return [(p, at[p]) for p in paths or () if len(at.get(p, "")) > 1]


def free(taken: Column, start: Column, end: Column) -> Column:
    """Whether a stretch overlaps none of some spans."""
    return ~F.exists(taken, lambda t: (t["start"] < end) & (start < t["end"]))


def mismatch_spans(rows: DataFrame, response: str, changed: str, tagged: str, values: str | None = None) -> DataFrame:
    """rows(response, changed: the response with some values replaced, tagged: the answer with tags) -> with plain: the answer without tags, and labels: what of it no longer fits.

    By stages, each for changes that the ones before haven't placed: a tag that stands for the changed leaf; the leaf's first text in the
    answer; its new one; and, if nothing at all is marked, the whole answer as an implicit label. A text that also stands in a value of
    the changed response (of over two characters) fits and is not marked. Labels don't overlap; the first one counts. With values, a
    column of that name keeps these values.
    """
    d = rows.withColumn("_t", key_spans(F.col(tagged)))
    d = d.withColumn("plain", F.col("_t.text")).withColumn("_tags", F.col("_t.spans"))
    named = _pairs(d, "_tags", "key", "value")

    def one(r: str | None, c: str | None, tags: list[tuple] | None) -> tuple:
        before, after = leaf_list(r), leaf_list(c)
        return _paths(named(tags), _values(before)), _changes(before, after), long_values(after)

    kept_in = values or "_long"
    new = {"_paths": "array<string>", "_changes": "array<struct<path:string,orig:string,hall:string>>", kept_in: "array<string>"}
    d = with_columns(d.drop("_t"), new, [response, changed, "_tags"], one)
    d = d.withColumn("_kept", F.lower(F.array_join(kept_in, "\0"))).withColumn("_any", F.size(kept_in) > 0)
    kept = lambda t: F.col("_any") & F.col("_kept").contains(F.lower(t))
    kind = lambda c: F.when(c["hall"].isNotNull(), CONFLICT).otherwise(BASELESS)
    base = lambda c: F.concat(F.lit("Original: "), c["orig"], F.when(F.coalesce(F.length(c["hall"]), F.lit(0)) > 0, F.concat(F.lit("\nGenerated: "), c["hall"])).otherwise(""))
    meta = lambda c: F.concat(F.upper(kind(c)), F.lit("\n"), base(c))
    of = lambda path: F.get(F.filter("_changes", lambda c: c["path"] == path), 0)
    # Tags of changed leaves.
    paired = F.filter(F.zip_with("_tags", "_paths", lambda t, p: F.struct(t.alias("t"), of(p).alias("c"))), lambda x: x["c"].isNotNull())
    d = d.withColumn("_paired", paired)
    first = F.transform(F.filter("_paired", lambda x: ~kept(x["t"]["value"])), lambda x: label(x["t"]["start"], x["t"]["end"], x["t"]["value"], meta(x["c"]), kind(x["c"])))
    d = d.withColumn("_spans", apart(first)).withColumn("_left", F.filter("_changes", lambda c: ~F.exists("_paired", lambda x: x["c"]["path"] == c["path"])))
    # Texts of the others: the old one if it has a free place, else the new one.
    acc_kind = f"struct<s:array<{LABEL}>,left:array<struct<path:string,orig:string,hall:string>>>"
    start = F.struct(F.col("_spans").alias("s"), F.array().cast("array<struct<path:string,orig:string,hall:string>>").alias("left")).cast(acc_kind)

    def place(acc: Column, text: Column) -> Column:
        good = (F.length(text) > 1) & ~kept(text)
        return F.when(F.coalesce(good, F.lit(False)), bound(F.instr(F.col("plain"), text) - 1, lambda at: F.when((at >= 0) & free(acc["s"], at, at + F.length(text)), at)))

    def step(acc: Column, c: Column) -> Column:
        old, new = place(acc, c["orig"]), place(acc, c["hall"])
        put = lambda at, text: F.struct(F.array_append(acc["s"], label(at, at + F.length(text), text, meta(c), kind(c))).alias("s"), acc["left"].alias("left")).cast(acc_kind)
        left = F.struct(acc["s"].alias("s"), F.array_append(acc["left"], c).alias("left")).cast(acc_kind)
        later = bound(new, lambda at: F.when(at.isNotNull(), put(at, c["hall"])).otherwise(left))
        return bound(old, lambda at: F.when(at.isNotNull(), put(at, c["orig"])).otherwise(later))

    d = d.withColumn("_done", F.aggregate("_left", start, step))
    parts = F.array_join(F.transform("_done.left", lambda c: F.concat(F.lit("Path: "), c["path"], F.lit("\n"), base(c))), "\n---\n")
    note = F.concat(F.lit("IMPLICIT HALLUCINATION\nThe answer relies on corrupted data not directly quoted.\n\n"), parts)
    whole = F.array(label(F.lit(0), F.length("plain"), F.col("plain"), note, F.lit(CONFLICT), True, True))
    implicit = (F.size("_done.left") > 0) & (F.size("_done.s") == 0) & F.col("plain").rlike(r"\S")
    d = d.withColumn("labels", F.array_sort(F.when(implicit, whole).otherwise(F.col("_done.s")), lambda a, b: a["start"] - b["start"]))
    return d.drop("_tags", "_paths", "_changes", "_long", "_kept", "_any", "_paired", "_spans", "_left", "_done")


WHOLE, SPLIT = re.compile(r"[+-]?[0-9]{1,18}"), re.compile(r"[+-]?[0-9]{1,18}(?=\.)")


def written_forms(value: str) -> list[str]:
    """A value and, of a number, its forms with commas and behind currency signs, in the order in which they are looked for."""
    forms = [value]
    if WHOLE.fullmatch(value):
        whole = f"{int(value):,}"
        forms += [whole, *[s + x for s in CURRENCIES for x in (whole, value)]]
    elif head := SPLIT.match(value):
        decimal = f"{int(head[0]):,}{value[head.end():]}"
        forms += [decimal, *[s + decimal for s in CURRENCIES]]
    return list(dict.fromkeys(forms))


def untagged(text: str | None) -> tuple[str | None, list[tuple[int, int, str, str]] | None]:
    """The text of an answer with tags, and (start, end, key, value) of these in it, as examples.key_spans has them."""
    if text is None:
        return None, None
    parts, tags, last, at = [], [], 0, 0
    for m in TAG.finditer(text):
        parts += [text[last : m.start()], m[2]]
        at += m.start() - last
        tags.append((at, at + len(m[2]), m[1], m[2]))
        last, at = m.end(), at + len(m[2])
    return "".join([*parts, text[last:]]), tags


class Taken:
    """Stretches that don't overlap."""

    def __init__(self) -> None:
        self.ends: list[int] = []
        self.starts: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Adds a stretch unless it overlaps one."""
        i = bisect_right(self.ends, start)
        if i < len(self.ends) and self.starts[i] < end:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


#: What of an answer is no white space.
SEEN = re.compile(r"\S", re.ASCII)


def _deletion_labels(plain: str | None, tags: list[tuple] | None, said: list[tuple] | None, lost: list[tuple[str, str]] | None, gone: list[str | None] | None) -> list[tuple]:
    """The labels of deletion_spans: said as (tag, path, value), lost as (path, value)."""
    if plain is None:
        return []
    said, lost = said or (), lost or ()
    forms = {v: [(lowered(f), len(f)) for f in written_forms(v)] for v in (*(x[2] for x in said), *(x[1] for x in lost)) if v is not None and len(v) > 1}
    at = places(lowered(plain), {f for each in forms.values() for f, _ in each})
    taken, found, placed = Taken(), [], set()

    def put(path: str | None, value: str | None, stretches: list[tuple[int, int]]) -> None:
        meta = None if path is None or value is None else f"EVIDENT BASELESS INFO\nPath (deleted): {path}\nOriginal value: {value}"
        found.extend((start, end, plain[start:end], meta, BASELESS, False, True) for start, end in stretches if taken.take(start, end))

    everywhere = lambda v: [(s, s + n) for f, n in forms.get(v, ()) for s in at.get(f, ())]
    for tag, path, value in said:
        named = [t for t in tags or () if t[2] == tag]
        hit = next((t for t in named if value is not None and (value in t[3] or t[3] in value)), named[0] if named else None)
        stretches = ([] if hit is None else [hit[:2]]) + everywhere(value)
        if stretches:
            placed.add(path)
        put(path, value, stretches)
    for path, value in lost:
        if path not in placed:
            put(path, value, everywhere(value))
    if not found and gone and SEEN.search(plain):
        note = "IMPLICIT HALLUCINATION\nAnswer references data deleted from tool_response.\n\n" + "\n".join(f"Deleted: {p}" for p in gone if p is not None)
        return [(0, len(plain), plain, note, BASELESS, True, True)]
    return _joined(plain, sorted(found, key=lambda x: x[0]))


def _joined(text: str, labels: list[tuple]) -> list[tuple]:
    """Labels in order; one that only white space parts from the one before is joined to it, and keeps that one's note."""
    out: list[tuple] = []
    for s in labels:
        if out and not SEEN.search(text[out[-1][1] : s[0]]):
            start, _, _, meta, kind, _, null = out.pop()
            s = (start, s[1], text[start : s[1]], meta, kind, False, null)
        out.append(s)
    return out


def deletion_spans(rows: DataFrame, response: str, tagged: str, marked: str, deleted: str) -> DataFrame:
    """rows(response, tagged: the answer with tags, marked: array of struct(tag, path, original_value), deleted: array of paths) -> with plain and labels: what of the answer the deletion leaves without ground.

    For each marked value the first tag of its name that is like it (or else that name's first tag), then all places of the value and of
    its written forms, in any case; then the same for deleted paths that nothing has placed yet. Where there are none, the whole answer
    is one implicit label. Labels don't overlap, the first one counts; those with only white space between are joined.
    """
    read = {"plain": "string", "_tags": "array<struct<start:int,end:int,key:string,value:string>>", "_lost": "array<struct<path:string,value:string>>"}
    d = with_columns(rows, read, [response, tagged, deleted], lambda r, t, g: (*untagged(t), values_in(r, g)))
    said = F.transform(marked, lambda x: F.struct(x["tag"].alias("tag"), x["path"].alias("path"), x["original_value"].cast("string").alias("value")))
    d = d.withColumn("_said", said)
    d = with_columns(d, {"labels": f"array<{LABEL}>"}, ["plain", "_tags", "_said", "_lost", deleted], lambda *x: (_deletion_labels(*x),))
    return d.drop("_tags", "_lost", "_said")


def comment_spans(answer: Column, comment: Column, tool: Column) -> Column:
    """The label of a comment added to an answer's end, or, if it isn't quite at the end, of its last place; none if it is empty or absent."""
    back = F.instr(F.reverse(answer), F.reverse(comment))
    start = F.length(answer) - back + 1 - F.length(comment)
    meta = F.concat(F.lit("EVIDENT BASELESS INFO\nOvergenerated sentence referencing tool(s) not used in this dialogue.\nUsed tool: "), F.coalesce(tool, F.lit("?")))
    there = (F.length(comment) > 0) & (back > 0)
    return F.when(there, F.array(label(start, start + F.length(comment), comment, meta, F.lit(BASELESS)))).otherwise(F.array().cast(f"array<{LABEL}>"))

