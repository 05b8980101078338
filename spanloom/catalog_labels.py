"""Queries of the label builders, over orders as tool responses and answers that quote them, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.catalog import query
from spanloom.catalog_editing import ORDERS_SQL, order_responses
from spanloom.functions import json_tree
from spanloom.operators import editing, labels, rows


def shown(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit(":"), s["end"], F.lit(":"), s["implicit_true"].cast("string"), F.lit(":"), s["label_type"])), ",")


_REST = "list_concat({0}, flatten(list_transform(range(0, m), lambda j: [cast(items[j + 1].n as varchar), {1}, cast(items[j + 1].q as varchar)])))"
_PART = "cast(items[j + 1].p as varchar)"


@query(f"""with {ORDERS_SQL}, v as (select *, cast(items[1].p as varchar) as old, {_REST.format("['order', cast(k as varchar), cast(total as varchar), status]", f"case when j > 0 then {_PART} end")} as after from o),
w as (select *, length(old) as n, length(old) > 2 and list_contains(after, old) as fits from v)
select k, case k % 4 when 0 then '5:' || (5 + n) || ':false:Evident Conflict' || case when n > 2 and not fits then ',' || (26 + n) || ':' || (26 + 2 * n) || ':false:Evident Conflict' else '' end
when 1 then '0:8:true:Evident Conflict' when 2 then '5:10:false:Evident Conflict' else '0:4:true:Evident Conflict' end as labels,
case k % 4 when 0 then 'Part ' || old || ' is here; again part ' || old || '.' when 1 then 'Nothing.' when 2 then 'This order, order.' else 'AzzB' end as output from w""")
def mismatch_labels(spark, sf_dir):
    """A changed part said twice; one that changed in case only; a value that an unchanged leaf also has; a short value inside a word."""
    d, way = order_responses(spark, sf_dir), F.col("k") % 4
    old, new = F.col("items")[0]["l_partkey"].cast("string"), F.concat(F.lit("x"), F.col("k"), F.lit("y"))
    d = d.withColumn("changed", F.regexp_replace("response", r'\A(.*?"part":)[0-9]+', F.concat(F.lit('$1"'), new, F.lit('"'))))
    answer = F.when(way == 0, F.concat(F.lit("Part "), old, F.lit(" is here; again part "), old, F.lit("."))).when(way == 1, "Nothing.").when(way == 2, "This order, order.").otherwise("AzzB")
    said = F.when(way == 0, F.concat(F.lit("EVIDENT CONFLICT\nOriginal: "), old, F.lit("\nGenerated: "), new)).when(way == 1, "Original: Ab\nGenerated: aB").when(way == 2, "Original: order\nGenerated: parcel").otherwise("Original: z\nGenerated: y")
    one = F.array(F.struct(said.alias("meta"), F.lit("Evident Conflict").alias("label_type"), F.lit(False).alias("implicit_true"), F.lit(False).alias("due_to_null")))
    d = d.withColumns({"said": answer, "tagged": F.lit(None).cast("string"), "evaluated": one, "asked": F.lit("Which part?")})
    d = labels.mismatch_labels(d.select("k", "said", "response", "changed", "tagged", "evaluated", "asked"), "said", "response", "changed", "tagged", "evaluated", "asked")
    return d.select("k", shown(F.col("labels")).alias("labels"), "output")


@query(f"""with {ORDERS_SQL}, v as (select *, cast(total as varchar) as t, format('{{:,}}', total) as c, cast(k as varchar) as ks, {_REST.format("['order', status]", _PART)} as rest from o),
w as (select *, length(t) as n, length(c) as nc, length(ks) as nk, list_contains(list_filter(list_append(rest, ks), lambda y: length(y) > 2), t) as t_fits, list_contains(list_filter(list_append(rest, t), lambda y: length(y) > 2), ks) as k_fits_1, length(ks) > 2 and list_contains(rest, ks) as k_fits, len(list_filter(list_append(rest, ks), lambda y: contains(y, t))) > 0 as t_in from v)
select k, case k % 4 when 0 then case when t_fits then '' else '4:' || (4 + n) || ':false:Baseless Info,' || (9 + n) || ':' || (9 + 2 * n) || ':false:Baseless Info' end
when 1 then '5:' || (5 + nc) || ':false:Evident Baseless Info'
when 2 then array_to_string(list_filter([case when not k_fits then '6:' || (6 + nk) || ':false:Baseless Info' end, case when not t_in then (12 + nk) || ':' || (13 + nk + nc) || ':false:Baseless Info' end], lambda x: x is not null), ',')
else array_to_string(list_filter([case when not k_fits then '6:' || (case when t_in then 6 else 15 end + nk) || ':false:Baseless Info' end, (19 + nk) || ':' || (69 + nk) || ':false:Baseless Info'], lambda x: x is not null), ',') end as labels from w""")
def deletion_labels(spark, sf_dir):
    """The total is gone: marked and said twice; unmarked, so that its spans are detected; unmarked beside another mark, behind a sign; and a list item that no value of the response is in, below a mark whose neighbour is lost."""
    d, way = order_responses(spark, sf_dir), F.col("k") % 4
    t, c, k = F.col("total").cast("string"), F.format_number("total", 0), F.col("k").cast("string")
    answer = F.when(way == 0, F.concat(F.lit("Sum "), t, F.lit(" and "), t, F.lit("."))).when(way == 1, F.concat(F.lit("Sum €"), c, F.lit(" now"))).when(way == 2, F.concat(F.lit("Order "), k, F.lit("; sum €"), c))
    answer = answer.otherwise(F.concat(F.lit("Order "), k, F.lit(" totals: \n\n"), F.lit("  - **Gift** wrapped up with ribbons and a nice card ")))
    mark = lambda tag, v: F.struct(F.lit(tag).alias("tag"), F.lit(f"results.{tag}").alias("path"), v.alias("original_value"), F.lit("Baseless Info").alias("label_type"))
    marked = F.when(way == 0, F.array(mark("total", t))).when(way == 1, F.slice(F.array(mark("order", k)), 1, 0)).otherwise(F.array(mark("order", k)))
    gone = F.when(way >= 2, F.array(F.lit("results.order"), F.lit("results.total"))).otherwise(F.array(F.lit("results.total")))
    reduced = F.when(way >= 2, json_tree.delete_path(json_tree.delete_path("response", F.lit("results.total")), F.lit("results.order"))).otherwise(json_tree.delete_path("response", F.lit("results.total")))
    d = d.withColumns({"said": answer, "marked": marked, "gone": gone, "reduced": reduced})
    d = labels.deletion_labels(d.select("k", "said", "response", "reduced", "marked", "gone"), "said", "response", "reduced", "said", "marked", "gone")
    return d.select("k", shown(F.col("labels")).alias("labels"))


@query(f"""with {ORDERS_SQL}, v as (select *, cast(items[1].p as varchar) as p from o), w as (select *, case k % 5 when 0 then 'Part ' || p || ', Part ' || p || '.' when 1 then 'It cost ¥' || format('{{:,}}', total) || ' and ' || k || '.' when 2 then 'Fine.' || chr(10) || 'The rating is splendid.' when 3 then 'Shipped too. Ships also can.' else 'Nothing' end as output from v)
select k, output, case k % 5 when 0 then case when length(p) > 2 then '5:' || (5 + length(p)) || ',' || (12 + length(p)) || ':' || (12 + 2 * length(p)) else '5:' || (5 + length(p)) end when 1 then case when total <> k and total > 99 then '8:' || (9 + length(format('{{:,}}', total))) else '' end when 2 then '6:29' when 3 then '13:28' else '' end as places,
case when k % 5 = 4 then 'no_labels' when k % 5 = 1 and not (total <> k and total > 99) then 'no_labels' end as refused, case k % 5 when 3 then 'multistep_type3_tool' when 0 then 'multistep_type1' when 4 then 'multistep_type1' else 'multistep_type2' end as task_type,
'System:' || chr(10) || 'find' || chr(10) || chr(10) || 'User:' || chr(10) || 'Order?' || chr(10) || chr(10) || 'Assistant:' || chr(10) || 'find()' || chr(10) || chr(10) || 'Tool:' || chr(10) || 'n ' || k as input_str from w""")
def dialogue_labels(spark, sf_dir):
    """Edited dialogues: a tagged text said twice, a price that only its number gives away, a line that a field's name gives away, a comment, and a tagged text that the response still holds, which is refused."""
    d, way = order_responses(spark, sf_dir), F.col("k") % 5
    p, price = F.col("items")[0]["l_partkey"].cast("string"), F.format_number("total", 0)
    answer = F.when(way == 0, F.concat(F.lit("Part <hall>"), p, F.lit("</hall>, Part "), p, F.lit("."))).when(way == 1, F.concat(F.lit("<hall>It cost ¥"), price, F.lit(" and "), F.col("k"), F.lit(".</hall>")))
    answer = answer.when(way == 2, "<hall>Fine.\nThe rating is splendid.</hall>").when(way == 3, "Shipped too. <hall>Ships also can.</hall>").otherwise("<hall>Nothing</hall>")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    d = d.withColumn("messages", F.array(turn("user", F.lit("Order?")), turn("assistant", F.lit("find()")), turn("tool", F.concat(F.lit("n "), F.col("k"))), turn("assistant", answer)))
    kind = F.when(way == 3, "type3_tool").when(way.isin(1, 2), "type2").otherwise("type1")
    d = d.withColumns({"kind": kind, "targets": F.when(way == 2, F.array(F.lit("results.splendidRating_x"))), "system": F.lit("find")}).select("k", "messages", "kind", "targets", "system")
    d = labels.dialogue_rows(d, "messages", "kind", "targets", "system")
    places = F.array_join(F.transform("labels", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",")
    e = labels.exported(d, "k", "query", "context", "output", F.concat(F.lit("multistep_"), "kind"), "labels", F.col("input_str"), places.alias("places"), F.col("refused"))
    return e.select(F.col("id").alias("k"), "output", "places", "refused", "task_type", "input_str")


@query(f"""with {ORDERS_SQL}, v as (select *, length(answer) as n from said) select k, case k % 3 when 0 then case when n >= 12 then '0:6:false:Evident Conflict' else '' end when 1 then '0:5:false:Baseless Info,6:8:false:Baseless Info' else n + 2 || ':' || (n + 2 + 25) || ':false:Overgeneration' end as labels,
case k % 3 when 0 then '{{"evident_conflict":1,"baseless_info":0,"overgeneration":0}}' when 1 then '{{"evident_conflict":0,"baseless_info":2,"overgeneration":0}}' else '{{"evident_conflict":0,"baseless_info":0,"overgeneration":1}}' end as processed, case k % 3 when 0 then 'type1_1' when 1 then 'type2_1_deletion' else 'type3_1' end as task_type from v""")
def exported_rows(spark, sf_dir):
    """Rows of three kinds with labels of their own: stored ones (one without a place and one over all of the answer go), placed ones, and a comment."""
    d, way = order_responses(spark, sf_dir), F.col("k") % 3
    place = lambda a, b: F.struct(F.lit(a).alias("start"), b.cast("int").alias("end"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("meta"), F.lit(None).cast("string").alias("label_type"), F.lit(None).cast("boolean").alias("implicit_true"), F.lit(None).cast("boolean").alias("due_to_null"))
    stored = F.array(place(-1, F.lit(3)), place(0, F.lit(6)), place(0, F.length("answer")))
    spot = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("t").alias("text"))
    comment = F.lit("I can also cancel orders.")
    said = F.when(way == 2, F.concat("answer", F.lit("\n\n"), comment)).otherwise(F.col("answer"))
    d = d.withColumn("said", said).withColumn("labels", F.when(way == 0, labels.stored_labels(stored, F.col("said"))).when(way == 1, labels.placed_labels(F.array(spot(0, 5), spot(6, 8)))).otherwise(labels.comment_labels(F.col("said"), comment)))
    kind = F.when(way == 0, "type1_1").when(way == 1, "type2_1_deletion").otherwise("type3_1")
    e = labels.exported(d, "k", "said", "response", "said", kind, "labels", F.col("said"))
    back = F.from_json("hallucination_labels", f"array<{editing.LABEL}>")
    return e.select(F.col("id").alias("k"), shown(back).alias("labels"), F.col("hallucination_labels_processed").alias("processed"), "task_type")


@query(f"""with {ORDERS_SQL} select k as dialogue_id, case when k % 2 = 0 then 'How much is ' || k || '?' else 'asked' end as query, case k % 4 when 0 then 2 when 1 then 1 when 2 then 1 else 0 end as n_contexts,
case k % 4 when 0 then 'total: ' || total || chr(10) || 'status: ' || status || chr(10) || chr(10) || 'plain' when 1 then 'total: ' || total when 2 then status || ' text' else '' end as context, answer as output, case when k % 3 = 0 then 'clean' else 'other' end as gold_type, case when k % 5 = 0 then '' else '0:5:Order' end as spans from said""")
def flat_examples(spark, sf_dir):
    """Rows under other names: a question or else a prompt, and contexts as a JSON list, as one JSON object, as a text, or none."""
    d, way = order_responses(spark, sf_dir), F.col("k") % 4
    total = F.to_json(F.struct("total"))
    context = F.when(way == 0, F.concat(F.lit("["), F.to_json(F.struct("total", "status")), F.lit(', "plain"]'))).when(way == 1, total).when(way == 2, F.concat("status", F.lit(" text")))
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("Order").alias("text")), F.struct(F.lit(5).alias("start"), F.lit(5).alias("end"), F.lit("").alias("text")))
    flat = d.select(F.col("k").alias("id"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("How much is "), "k", F.lit("?"))).alias("question"), F.lit("asked").alias("prompt"), F.col("answer"), context.alias("tool_response"), F.when(F.col("k") % 3 == 0, "clean").alias("type"), F.lit("other").alias("class"), F.when(F.col("k") % 5 != 0, one).alias("gold"))
    spans = F.array_join(F.transform("gold_spans", lambda s: F.concat(s["start"], F.lit(":"), s["end"], F.lit(":"), s["text"])), ",")
    return rows.flat_examples(flat).select("dialogue_id", "query", F.size("contexts").alias("n_contexts"), "context", "output", "gold_type", spans.alias("spans"))
