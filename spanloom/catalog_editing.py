"""Queries of edited answers, over orders as tool responses and answers that quote them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.catalog import _table, dealt, orders_with_items, query
from spanloom.functions import json_tree, text
from spanloom.operators import editing, examples, spans
from spanloom.operators.examples import CURRENCIES, key_spans

# Responses: {"name": "order", "results": {order, total, status, items: [{line, part, pieces}]}}; answers name the order, its status, its
# total (with commas for odd orders) and its items, every fifth of them only the first.
ORDERS_SQL = """it as (select l_orderkey as k, list({'n': l_linenumber, 'p': l_partkey, 'q': cast(l_quantity as bigint)} order by l_linenumber, l_partkey, l_quantity) as items from lineitem group by l_orderkey),
o as (select o_orderkey as k, cast(floor(o_totalprice) as bigint) as total, o_orderstatus as status, items, len(items) as m from orders join it on k = o_orderkey),
said as (select *, 'Order ' || k || ' is ' || status || ' and totals ' || case when k % 2 = 1 then format('{:,}', total) else cast(total as varchar) end || '.'
  || array_to_string(list_transform(case when k % 5 = 0 then items[1:1] else items end, lambda x: ' Part ' || x.p || ': ' || x.q || ' pieces.'), '') as answer from o)"""


def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, total, status, items, response, answer."""
    d = orders_with_items(spark, sf_dir, [F.floor("o_totalprice").cast("bigint").alias("total"), F.col("o_orderstatus").alias("status")], dealt(spark)).withColumnRenamed("o_orderkey", "k")
    inner = F.struct(F.col("k").alias("order"), "total", "status", F.transform("items", lambda x: F.struct(x["l_linenumber"].alias("line"), x["l_partkey"].alias("part"), x["l_quantity"].alias("pieces"))).alias("items"))
    d = d.withColumn("response", F.to_json(F.struct(F.lit("order").alias("name"), inner.alias("results"))))
    line = lambda x: F.concat(F.lit(" Part "), x["l_partkey"], F.lit(": "), x["l_quantity"], F.lit(" pieces."))
    named = F.transform(F.when(F.col("k") % 5 == 0, F.slice("items", 1, 1)).otherwise(F.col("items")), line)
    total = F.when(F.col("k") % 2 == 1, F.format_number("total", 0)).otherwise(F.col("total").cast("string"))
    return d.withColumn("answer", F.concat(F.lit("Order "), "k", F.lit(" is "), "status", F.lit(" and totals "), total, F.lit("."), F.array_join(named, "")))


# A leaf: key, value, number of the leaf.
_ALL = """list_concat([{'k': 'name', 'v': 'order', 'i': 0}, {'k': 'order', 'v': cast(k as varchar), 'i': 1}, {'k': 'total', 'v': cast(total as varchar), 'i': 2}, {'k': 'status', 'v': status, 'i': 3}],
  flatten(list_transform(range(0, m), lambda j: [{'k': 'line', 'v': cast(items[j + 1].n as varchar), 'i': cast(4 + 3 * j as int)}, {'k': 'part', 'v': cast(items[j + 1].p as varchar), 'i': cast(5 + 3 * j as int)}, {'k': 'pieces', 'v': cast(items[j + 1].q as varchar), 'i': cast(6 + 3 * j as int)}])))"""
_FREE = "list_filter(range(0, length(answer) - length(x.v) + 1), lambda p: substr(low, p + 1, length(x.v)) = lower(x.v) and len(list_filter(acc, lambda t: t.s < p + length(x.v) and p < t.e)) = 0)[1]"


@query(f"""with {ORDERS_SQL}, l as (select *, lower(answer) as low, {_ALL} as leaves from said),
s as (select *, list_transform(list_sort(list_transform(leaves, lambda x: {{'n': -length(x.v), 'i': x.i, 'k': x.k, 'v': x.v}})), lambda x: {{'k': x.k, 'v': x.v}}) as byl from l),
t as (select *, list_reduce(byl, lambda acc, x: case when {_FREE} is not null then list_append(acc, {{'s': {_FREE}, 'e': {_FREE} + length(x.v), 'k': x.k}}) else acc end, cast([] as struct(s bigint, e bigint, k varchar)[])) as taken from s)
select k, list_reduce(list_reverse_sort(taken), lambda acc, x: substr(acc, 1, x.s) || '[' || x.k || ']' || substr(acc, x.s + 1, x.e - x.s) || '[/' || x.k || ']' || substr(acc, x.e + 1), answer) as tagged_answer, cast(len(taken) as int) as num_tags,
cast(len(list_filter(byl, lambda x: len(list_filter(taken, lambda t: contains(substr(low, t.s + 1, t.e - t.s), lower(x.v)))) = 0)) as int) as num_unmatched from t""")
def tagged_answers(spark, sf_dir):
    return editing.tag_answers(order_responses(spark, sf_dir).select("k", "response", "answer"), "response", "answer", tags=False).select("k", "tagged_answer", "num_tags", "num_unmatched")


@query("""with it as (select l_orderkey as k, list(cast(l_partkey as varchar) order by l_linenumber, l_partkey, l_quantity) as v from lineitem where l_orderkey in (select o_orderkey from orders) group by l_orderkey),
t as (select *, case k % 3 when 0 then v when 1 then list_reverse(v) else list_transform(range(0, len(v)), lambda j: case when j % 2 = 0 then 'none' else v[j + 1] end) || ['more'] end as tags from it),
r as (select *, list_reduce(tags, lambda acc, x: {'c': coalesce(list_filter(range(acc.c, len(v)), lambda j: contains(x, v[j + 1]) or contains(v[j + 1], x))[1], acc.c) + 1,
  'o': list_append(acc.o, coalesce(list_filter(range(acc.c, len(v)), lambda j: contains(x, v[j + 1]) or contains(v[j + 1], x))[1], case when acc.c < len(v) then acc.c end))}, {'c': cast(0 as bigint), 'o': cast([] as bigint[])}) as r from t)
select k, array_to_string(list_transform(r.o, lambda j: coalesce('results.items.' || j || '.part', '-')), ',') as paths from r""")
def tags_of_repeated_keys(spark, sf_dir):
    """Parts of each order as tags: in their order, crosswise, and with every second one unlike any and one too many."""
    d = order_responses(spark, sf_dir)
    values = F.transform("items", lambda x: x["l_partkey"].cast("string"))
    unlike = F.array_append(F.transform(values, lambda v, j: F.when(j % 2 == 0, "none").otherwise(v)), F.lit("more"))
    tags = F.when(F.col("k") % 3 == 0, values).when(F.col("k") % 3 == 1, F.reverse(values)).otherwise(unlike)
    d = d.withColumn("tagged", F.array_join(F.transform(tags, lambda v: F.concat(F.lit("[part]"), v, F.lit("[/part]"))), ", "))
    d = d.select("k", "response", key_spans(F.col("tagged"))["spans"].alias("tags"))
    return editing.response_paths(d, "tags", "response", "p").select("k", F.array_join("p", ",", "-").alias("paths"))


def _forms(v: str) -> str:
    return " || ".join(f"list_transform(f || [{v}], lambda y: '{s}' || y)" for s in CURRENCIES)


_COUNT = "(length(low) - length(replace(low, lower({0}), ''))) // length({0})"
# Of each leaf under results: the first form of its value that the answer holds, with n, s and e.
SPOTS_SQL = f"""lv as (select k, answer, lower(answer) as low, m, unnest(list_filter({_ALL}, lambda x: x.i > 0)) as x from said),
lf as (select *, x.v as v, case when regexp_full_match(x.v, '[0-9]+') and length(x.v) >= 3 then list_distinct([x.v, format('{{:,}}', try_cast(x.v as bigint))]) else [x.v] end as f from lv),
lw as (select *, [v] || case when regexp_full_match(v, '[0-9]+') then f || {_forms("v")} || [v || '%', v || ' %'] else cast([] as varchar[]) end as forms from lf),
ls as (select k, answer, low, m, x.k as name, x.i as i, case when length(v) >= 3 then list_filter(forms, lambda y: contains(low, lower(y)))[1] end as form from lw),
spot as (select k, answer, m, name, i, coalesce({_COUNT.format("form")}, 0) as n, instr(low, lower(form)) - 1 as s, instr(low, lower(form)) - 1 + length(form) as e,
  case when i <= 3 then name else 'items.' || ((i - 4) // 3) || '.' || name end as path from ls)"""


@query(f"""with {ORDERS_SQL}, {SPOTS_SQL}, c as (select k, max(n) as most, list_sort(list_distinct(list({{'start': s, 'end': e}}) filter (where n = 1))) as l from spot group by k)
select k, most > 1 as unclear, case when most <= 1 then coalesce(array_to_string(list_transform(l, lambda x: x.start || ':' || x."end"), ','), '') end as places from c""")
def unambiguous_places(spark, sf_dir):
    """Where the values of each response stand in its answer, unless one stands twice."""
    d = editing.placed_leaves(order_responses(spark, sf_dir).select("k", "response", "answer"), "response", "answer", "leaves", "spots").select("k", editing.sure_places(F.col("spots")).alias("p"))
    return d.select("k", F.col("p").isNull().alias("unclear"), F.array_join(F.transform("p", lambda x: F.concat(x["start"], F.lit(":"), x["end"])), ",").alias("places"))


@query(f"""with {ORDERS_SQL}, {SPOTS_SQL}, c as (select *, case when i <= 3 then path else 'items.' || ((i - 4) // 3) end as cand, 3 + 3 * m as total from spot),
g as (select k, cand, any_value(answer) as answer, any_value(total) as total, count(*) as size, max(n) as most, list_distinct(list({{'s': s, 'e': e}}) filter (where n = 1)) as l from c group by k, cand),
p as (select c.k, c.path, c.cand, c.n, c.s, c.e, g.answer, g.total, g.size, g.most, coalesce(g.l, []) as l, right(c.path, 3) || c.path as o from c join g on c.k = g.k and c.cand = g.cand),
w as (select *, 2 * size <= total and most <= 1 and len(l) > 0 and 2 * coalesce(list_sum(list_transform(l, lambda x: x.e - x.s)), 0) <= length(answer) as whole, cand <> path and 2 * size <= total and most <= 1 and len(l) = 0 and n = 1 and 2 * (e - s) <= length(answer) as flat from p),
f as (select *, row_number() over (partition by k order by o) as r from w where whole or flat)
select o.k, 'results.' || case when whole then cand else path end as path, whole and cand <> path as cascade, cast(case when whole then len(l) else 1 end as int) as n_spans, cast(case when whole then list_sum(list_transform(l, lambda x: x.e - x.s)) else e - s end as bigint) as covered, cast(floor(100.0 * case when whole then size else 1 end / f.total + 0.5) as int) as pct_deleted, cast(f.total - case when whole then size else 1 end + 1 as int) as left_leaves
from o left join f on o.k = f.k and f.r = 1""")
def budgeted_deletions(spark, sf_dir):
    d = editing.budgeted_deletions(order_responses(spark, sf_dir).select("k", "response", "answer"), "response", "answer", lambda p: F.concat(F.substring(p, -3, 3), p))
    d = d.select("k", F.struct("deletion.path", "deletion.cascade", "deletion.n_spans", "deletion.spans", "deletion.pct_deleted").alias("deletion"), F.col("deletion.reduced").alias("reduced"))
    d = json_tree.printed_leaves(d, "reduced", "left")
    covered = F.aggregate("deletion.spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return d.select("k", "deletion.path", "deletion.cascade", "deletion.n_spans", covered.alias("covered"), "deletion.pct_deleted", F.size("left").alias("left_leaves"))


_NEW = "'x' || (k * 7) || 'y'"


@query(f"""with {ORDERS_SQL}, v as (select *, cast(items[1].p as varchar) as old, {_NEW} as new, list_filter(list_concat(['order', cast(k as varchar), cast(total as varchar), status, {_NEW}], flatten(list_transform(range(0, m), lambda j: [cast(items[j + 1].n as varchar), case when j > 0 then cast(items[j + 1].p as varchar) end, cast(items[j + 1].q as varchar)]))), lambda y: length(y) > 2) as after from o),
p as (select *, case k % 4 when 0 then 'It is ' || old || '.' when 1 then 'It is ' || old || '.' when 2 then 'Now ' || new || '.' else 'Nothing quoted.' end as plain, len(list_filter(after, lambda y: contains(y, old))) > 0 as fits from v),
r as (select *, case when k % 4 < 2 and not fits and (k % 4 = 0 or length(old) > 1) then 6 when k % 4 = 0 and fits then -2 else -1 end as pos from p)
select k, plain, case when pos >= 0 then pos || ':' || (pos + length(old)) || ':false' when pos = -1 then '0:' || length(plain) || ':true' else '' end as places, case when pos >= 0 then 'EVIDENT CONFLICT' || chr(10) || 'Original: ' || old || chr(10) || 'Generated: ' || new
when pos = -1 then 'IMPLICIT HALLUCINATION' || chr(10) || 'The answer relies on corrupted data not directly quoted.' || chr(10) || chr(10) || 'Path: results.items.0.part' || chr(10) || 'Original: ' || old || chr(10) || 'Generated: ' || new else '' end as notes from r""")
def mismatch_spans(spark, sf_dir):
    """The first part changes: quoted in a tag, quoted without one, only its new text quoted (which fits the changed response), or not quoted."""
    d, way = order_responses(spark, sf_dir), F.col("k") % 4
    old, new = F.col("items")[0]["l_partkey"].cast("string"), F.concat(F.lit("x"), F.col("k") * 7, F.lit("y"))
    d = d.withColumn("changed", F.regexp_replace("response", r'\A(.*?"part":)[0-9]+', F.concat(F.lit('$1"'), new, F.lit('"'))))
    d = d.withColumn("tagged", F.when(way == 0, F.concat(F.lit("It is [part]"), old, F.lit("[/part]."))).when(way == 1, F.concat(F.lit("It is "), old, F.lit("."))).when(way == 2, F.concat(F.lit("Now "), new, F.lit("."))).otherwise("Nothing quoted."))
    d = editing.mismatch_spans(d.select("k", "response", "changed", "tagged"), "response", "changed", "tagged")
    shown = F.transform("labels", lambda s: F.concat(s["start"], F.lit(":"), s["end"], F.lit(":"), s["implicit_true"].cast("string")))
    return d.select("k", "plain", F.array_join(shown, ",").alias("places"), F.array_join(F.transform("labels", lambda s: s["meta"]), "|").alias("notes"))


@query(f"""with {ORDERS_SQL}, v as (select *, cast(total as varchar) as t, format('{{:,}}', total) as c from o),
p as (select *, case k % 4 when 0 then 'Sum ' || t || ' ' || t || '; that is €' || c || '!' when 1 then 'Sum €' || c || ' in all' when 2 then 'Sum unknown, maybe ' || t else 'No sum at all' end as plain from v)
select k, plain, case k % 4 when 0 then '4:' || (5 + 2 * length(t)) || ':false,' || (16 + 2 * length(t)) || ':' || (16 + 2 * length(t) + length(c)) || ':false' when 1 then '5:' || (5 + length(c)) || ':false' when 2 then '4:11:false,19:' || (19 + length(t)) || ':false' else '0:13:true' end as places from p""")
def deletion_spans(spark, sf_dir):
    """The total is deleted: tagged, said again beside and with commas; only with commas behind a sign; a tag of its name unlike it; not there at all."""
    d, way = order_responses(spark, sf_dir), F.col("k") % 4
    t, c = F.col("total").cast("string"), F.format_number("total", 0)
    tagged = F.when(way == 0, F.concat(F.lit("Sum [total]"), t, F.lit("[/total] "), t, F.lit("; that is €"), c, F.lit("!"))).when(way == 1, F.concat(F.lit("Sum €"), c, F.lit(" in all")))
    tagged = tagged.when(way == 2, F.concat(F.lit("Sum [total]unknown[/total], maybe "), t)).otherwise("No sum at all")
    mark = F.array(F.struct(F.lit("total").alias("tag"), F.lit("results.total").alias("path"), t.alias("original_value")))
    d = d.withColumns({"tagged": tagged, "marked": F.when(way.isin(0, 2), mark).otherwise(F.slice(mark, 1, 0)), "gone": F.array(F.lit("results.total"))})
    d = editing.deletion_spans(d.select("k", "response", "tagged", "marked", "gone"), "response", "tagged", "marked", "gone")
    shown = F.transform("labels", lambda s: F.concat(s["start"], F.lit(":"), s["end"], F.lit(":"), s["implicit_true"].cast("string")))
    return d.select("k", "plain", F.array_join(shown, ",").alias("places"))


@query("""with c as (select doc_id, coalesce(text, '') as t, 'I can also look up source ' || coalesce(source, '?') || ' for you.' as c from documents)
select doc_id, case doc_id % 4 when 3 then 0 else 1 end as n, case when doc_id % 4 < 2 then length(t) + 2 when doc_id % 4 = 2 then length(t) + length(c) + 3 end as start, case when doc_id % 4 < 2 then length(t) + 2 + length(c) when doc_id % 4 = 2 then length(t) + 2 * length(c) + 3 end as "end" from c""")
def comment_spans(spark, sf_dir):
    """A sentence added to whole documents: at the end, before trailing blanks, said twice, or not at all."""
    way = F.col("doc_id") % 4
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.concat(F.lit("I can also look up source "), F.coalesce("source", F.lit("?")), F.lit(" for you.")).alias("c"))
    answer = F.when(way == 0, F.concat("t", F.lit("\n\n"), "c")).when(way == 1, F.concat("t", F.lit("\n\n"), "c", F.lit(" \n"))).when(way == 2, F.concat("c", F.lit(" "), "t", F.lit("\n\n"), "c")).otherwise(F.col("t"))
    made = editing.comment_spans(answer, F.col("c"), F.lit("find"))
    return d.select("doc_id", F.size(made).alias("n"), F.get(made, 0)["start"].alias("start"), F.get(made, 0)["end"].alias("end"))


_SAID = """d as (select doc_id, coalesce(source, '?') as s, coalesce(n_chars, 0) as n from documents), b as (select *, 'It came from ' || s || '. ' || case when doc_id % 2 = 0 then 'Really!  ' else '' end || 'It has ' || n || ' characters' || case doc_id % 3 when 0 then '.' else '' end as base from d)"""


@query(f"""with {_SAID} select doc_id, case doc_id % 4 when 0 then base when 1 then base when 2 then case when doc_id % 3 = 0 then regexp_replace(base, '  ', ' ') else 'It came from ' || s || '.' || case when doc_id % 2 = 0 then ' Really!' else '' end end else '' end as kept,
doc_id % 5 in (1, 4) as fit from b""")
def filler_removed(spark, sf_dir):
    """Answers about each document with filler: none; two paragraphs of it; a sentence behind a blank; nothing else. And comments: too short, fit, filler, said before, fit with three sentences."""
    i = F.col("doc_id")
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("s"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    base = F.concat(F.lit("It came from "), "s", F.lit(". "), F.when(i % 2 == 0, "Really!  ").otherwise(""), F.lit("It has "), "n", F.lit(" characters"), F.when(i % 3 == 0, ".").otherwise(""))
    d = d.withColumn("base", base)
    said = F.when(i % 4 == 0, F.concat(F.lit(" "), "base", F.lit("\n"))).when(i % 4 == 1, F.concat("base", F.lit("\n\nFeel free to write.\n\nAnything else you want?"))).when(i % 4 == 2, F.concat("base", F.lit(" Let me know."))).otherwise("Happy to help! ASK ME.")
    comment = F.get(F.array(F.lit("Too short"), F.concat(F.lit("It is number "), i, F.lit(" of many.")), F.lit("Reach out to us for all of it."), F.concat(F.lit("it CAME from "), "s", F.lit(". ")), F.lit("One is enough. Two is a pair. Three is it.")), (i % 5).cast("int"))
    return d.select("doc_id", text.without_filler(said).alias("kept"), text.comment_is_fit(comment, F.col("base")).alias("fit"))


@query(f"""with {ORDERS_SQL}, {SPOTS_SQL} select k, coalesce(string_agg('results.' || path, ',' order by i) filter (where n = 1), '') as paths from spot group by k""")
def quoted_paths(spark, sf_dir):
    return editing.quoted_paths(order_responses(spark, sf_dir).select("k", "response", "answer"), "response", "answer", "p").select("k", F.array_join("p", ",").alias("paths"))


@query(f"""with {ORDERS_SQL}, h as (select k, 'Order [order]' || k || '[/order] has part ' as head, list_transform(items, lambda x: cast(x.p as varchar)) as v from o), t as (select *, head || array_to_string(list_transform(v, lambda x: '[part]' || x || '[/part]'), ', ') || '.' as tagged from h),
a as (select *, list_transform(range(0, len(v)), lambda j: {{'s': length(head) + coalesce(list_sum(list_transform(v[1:j], lambda x: length(x) + 15)), 0), 'n': length(v[j + 1]) + 13, 'x': v[j + 1]}}) as tags from t)
select k, array_to_string(list_concat(case when k % 2 = 0 then ['results.order:6:' || (6 + 15 + length(cast(k as varchar))) || ':[order]' || k || '[/order]'] else [] end, list_transform(list_filter(tags, lambda y: contains(y.x, v[1]) or contains(v[1], y.x)), lambda y: 'results.items.0.part:' || cast(y.s as int) || ':' || cast(y.s + y.n as int) || ':[part]' || y.x || '[/part]')), ',') as found from a""")
def tagged_deletions(spark, sf_dir):
    """The first part goes, of even orders the number too, and a path that isn't there; all tags that show them."""
    d = order_responses(spark, sf_dir)
    parts = F.array_join(F.transform("items", lambda x: F.concat(F.lit("[part]"), x["l_partkey"], F.lit("[/part]"))), ", ")
    gone = F.array_compact(F.array(F.when(F.col("k") % 2 == 0, "results.order"), F.lit("results.items.0.part"), F.lit("results.items.99"), F.lit("results.0")))
    d = d.withColumns({"tagged": F.concat(F.lit("Order [order]"), "k", F.lit("[/order] has part "), parts, F.lit(".")), "gone": gone})
    d = editing.tagged_deletions(d.select("k", "response", "tagged", "gone"), "response", "tagged", "gone", "x")
    return d.select("k", F.array_join(F.transform("x", lambda y: F.concat_ws(":", y["path"], y["span_start"].cast("string"), y["span_end"].cast("string"), y["span_text"])), ",").alias("found"))


@query("""with t as (select vec_id as id, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 as pos from embeddings), w as (select id, pos, case when count(*) over a = 8 then avg(cast(v as double)) over a end as p from t window a as (partition by id order by pos rows between current row and 7 following))
select id, cast(pos as int) as pos, coalesce(avg(p) over b, 0.0) as probability, coalesce(avg(cast(p > 0.01 as int)) over b > 0.5, false) as factual from w window b as (partition by id order by pos rows between 7 preceding and current row)""")
def window_probabilities(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    tokens = e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return spans.window_probabilities(tokens, "id", "pos", "v", 8, 0.01)


@query("""with d as (select doc_id, coalesce(n_chars, 0) as n from documents) select doc_id, case doc_id % 4 when 0 then (doc_id % 50) || ':' || (doc_id % 50 + n + 1) when 1 then '7:' || (n + 8) else '' end as found from d""")
def gold_spans(spark, sf_dir):
    """Spans in the last message's JSON: one; several, of which only one is whole and not empty; in another's message; no JSON."""
    i, n = F.col("doc_id"), F.coalesce("n_chars", F.lit(0))
    span = lambda a, b: F.concat(F.lit('{"start": '), a, F.lit(', "end": '), b, F.lit("}"))
    one = F.concat(F.lit('So: {"type": "clean", "spans": ['), span(i % 50, i % 50 + n + 1), F.lit("]} as asked"))
    several = F.concat(F.lit('{"spans": ['), F.array_join(F.array(span(F.lit("5"), F.lit("5")), span(F.lit("1.5"), n + 9), span(F.lit('"3"'), n + 9), F.lit("4"), span(F.lit("7"), n + 8)), ", "), F.lit("]}"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.when(i % 4 == 0, F.array(message("user", F.lit("q")), message("assistant", one))).when(i % 4 == 1, F.array(message("assistant", several))).when(i % 4 == 2, F.array(message("assistant", one), message("user", one))).otherwise(F.array(message("assistant", F.lit("{no"))))
    found = _table(spark, sf_dir, "documents").select("doc_id", examples.gold_spans(messages).alias("s"))
    return found.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat(x["start"], F.lit(":"), x["end"])), ",").alias("found"))
