"""Queries of the tool operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.catalog import CALL_SQL, LABELLED_SQL, _table, labelled, orders_json, query
from spanloom.functions import json_tree
from spanloom.operators import tools


def _turns(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "tool_call").when((F.col("role") == "user") & (F.col("turn") % 4 == 2), "tool").otherwise(F.col("role"))
    said = F.when(role == "tool", F.concat(F.lit('[{"n":'), "turn", F.lit("}, 2]"))).otherwise(F.col("text"))
    return tools.turn_rows(c.withColumn("said", said).withColumn("role", role), "conv_id", "turn", "role", "said")


TURNS_SQL = f"""c as (select conv_id, turn, case when role = 'assistant' and turn % 4 = 1 then 'tool_call' when role = 'user' and turn % 4 = 2 then 'tool' else lower(trim(role)) end as role, coalesce(text, '') as text from conversations),
f as (select *, sum(cast(role = 'user' as int)) over (partition by conv_id order by turn) as segment, role = 'tool_call' or (role = 'assistant' and {CALL_SQL}) as call, role = 'assistant' and not {CALL_SQL} as answer from c),
a as (select *, min(turn) filter (where call) over s as first_call from f where segment > 0 window s as (partition by conv_id, segment)), b as (select *, max(turn) filter (where role = 'tool' and turn > first_call) over s as last_result from a window s as (partition by conv_id, segment)),
t as (select conv_id, segment, arg_min(text, turn) as user_prompt, max(text) filter (where turn = first_call) as tool_call, max(last_result) as r, arg_min(text, turn) filter (where answer and turn > last_result) as original_answer, min(turn) filter (where answer and turn > last_result) as answer_index from b group by all),
n as (select *, cast(row_number() over (partition by conv_id order by segment) - 1 as int) as turn, count(*) over (partition by conv_id) as turns from t where answer_index is not null and tool_call is not null and r is not null)"""


@query(f"""with {TURNS_SQL} select conv_id, turn, turns, user_prompt, tool_call, '{{"n":' || r || '}}' as tool_response, original_answer, answer_index from n""")
def turn_rows(spark, sf_dir):
    return _turns(spark, sf_dir)


@query(f"with {TURNS_SQL} select conv_id, turn, answer_index + 1 as keep from n where turn > 0")
def pruning_items(spark, sf_dir):
    return tools.pruning_items(_turns(spark, sf_dir), "conv_id")


CALLS = ('Find_Way(city="P, q", n_days=3)', '[{"name": "get_it", "arguments": {"b": 1, "a": {"c": 2}}}]', '{"name": "half", "arg', "bare", "[Two.Words (x = 1)]")
SYSTEMS = ('Use: [{"name": "get_it", "d": 1}, {"name": "other", "d": [2]}] only.', 'Tools [{"name": "get_it", "d": 9}]', "none", "", 'x [ {"name": "bare"}, {"no": 1} ]')


def _calls(spark, sf_dir):
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    i = F.col("doc_id")
    return _table(spark, sf_dir, "documents").select("doc_id", pick(CALLS, i % 5).alias("tool_call"), pick(SYSTEMS, F.floor(i / 5) % 5).alias("system"))


@query("""select doc_id, case doc_id % 5 when 0 then 'Find_Way' when 1 then 'get_it' when 2 then 'half' when 3 then 'bare' else 'Two.Words' end as name, case doc_id % 5 when 0 then 'city,n_days' when 1 then 'b,a' when 4 then 'x' else '' end as parameters,
case doc_id // 5 % 5 when 0 then case when doc_id % 5 = 1 then '{"d":[2],"name":"other"}' else '{"d":1,"name":"get_it"}|{"d":[2],"name":"other"}' end when 1 then '{"d":9,"name":"get_it"}' when 4 then '{"name":"bare"}' else '' end as offered from documents""")
def tool_calls(spark, sf_dir):
    call = F.col("tool_call")
    return _calls(spark, sf_dir).select("doc_id", tools.used_tool(call).alias("name"), F.array_join(tools.call_parameters(call), ",").alias("parameters"), F.array_join(tools.offered_tools(F.col("system"), call), "|").alias("offered"))


@query("""select * from (values ('get_it', '{"d":1,"name":"get_it"}', false), ('other', '{"d":[2],"name":"other"}', false), ('bare', '{"name":"bare"}', false), ('half', '{"name":"half","description":"Performs half operations."}', true),
('Find_Way', '{"name":"Find_Way","description":"Performs find way operations.","parameters":{"type":"dict","properties":{"city":{"type":"string","description":"city"},"n_days":{"type":"string","description":"n_days"}},"required":["city","n_days"]}}', true), ('Two.Words', '{"name":"Two.Words","description":"Performs two.words operations.","parameters":{"type":"dict","properties":{"x":{"type":"string","description":"x"}},"required":["x"]}}', true)) t(name, definition, made)""")
def tool_registry(spark, sf_dir):
    return tools.tool_registry(_calls(spark, sf_dir), "doc_id")


@query("select doc_id // 5 % 5 as kind, count(*) as n, count(*) filter (where doc_id // 5 % 5 = 3) as filled, case when doc_id // 5 % 5 = 3 then 6 else cast(length(case doc_id // 5 % 5 when 0 then 'x' when 1 then 'x' when 4 then 'x' else '' end) as int) end as tools from documents group by all")
def filled_systems(spark, sf_dir):
    d = tools.with_systems(_calls(spark, sf_dir), "doc_id", "Functions:\n")
    many = F.size(tools.defined_tools(F.col("system")))
    filled = F.col("system").startswith("Functions:")
    return d.select((F.floor(F.col("doc_id") / 5) % 5).alias("kind"), filled.alias("f"), F.when(filled, many).otherwise(F.least(many, F.lit(1))).alias("tools")).groupBy("kind", "tools").agg(F.count("*").alias("n"), F.count_if("f").alias("filled")).select("kind", "n", "filled", "tools")


@query("""with o as (select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem)) select o_orderkey, 'o_orderstatus' as path, 'Evident Conflict' as label_type, o_orderstatus as original, case when o_orderkey % 3 = 1 then 'Z' end as generated, false as due_to_null from o where o_orderkey % 3 < 2
union all select o_orderkey, 'extra', 'Baseless Info', null, '5', true from o""")
def changed_values(spark, sf_dir):
    """Orders whose status is taken out (a third), changed (a third) or kept, and that get a new value."""
    d, way = orders_json(spark, sf_dir), F.col("o_orderkey") % 3
    key = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    status = F.concat(F.lit('"o_orderstatus":'), key(F.col("o_orderstatus")))
    changed = F.concat(F.lit('"o_orderstatus":'), F.when(way == 0, F.lit("null")).when(way == 1, F.lit('"Z"')).otherwise(key(F.col("o_orderstatus"))), F.lit(',"extra":5'))
    after = d.withColumn("json", F.replace("json", status, changed))
    paths = d.select("o_orderkey", F.explode(F.array(*[F.lit(p) for p in ("o_orderstatus", "extra", "o_orderkey", "no.such")])).alias("path"))
    return tools.changed_values(json_tree.leaves(d, "o_orderkey", "json"), json_tree.leaves(after, "o_orderkey", "json"), paths, "o_orderkey")


@query(f"""with {LABELLED_SQL} select doc_id, case doc_id % 6 when 0 then 'OK' when 1 then 'FIXED' when 2 then 'GENUINE' when 3 then 'MISSING_OFFSETS' when 4 then 'OUT_OF_RANGE' else 'NO_ANSWER' end as code, doc_id % 6 = 1 as changed, case doc_id % 6 when 0 then 'co‑op' when 1 then 'co‑op' when 2 then 'coxop' when 3 then null else 'co‑op' end as text,
case when doc_id % 6 = 5 then 'NO_ANSWER' when doc_id % 6 = 2 then 'MISMATCH' when doc_id % 6 = 4 then 'OUTSIDE' when doc_id % 6 in (0, 1) and gold in ('clean', 'undergeneration') then 'SPANS_NOT_ALLOWED' end as reason from labelled where doc_id % 6 <> 3
union all select doc_id, 'MISSING_OFFSETS', false, null, 'MISMATCH' from labelled where doc_id % 6 = 3""")
def span_fixes(spark, sf_dir):
    way = F.col("doc_id") % 6
    answer = F.when(way != 5, "the co‑op shop")
    span = F.struct(F.when(way == 4, 30).otherwise(4).alias("start"), F.when(way == 4, 40).otherwise(9).alias("end"), F.when(way == 1, "co-op").when(way == 2, "coxop").when(way != 3, "co‑op").alias("text"))
    fix = tools.fixed_spans(answer, F.array(span))
    d = labelled(spark, sf_dir).select("doc_id", fix.alias("f"), tools.example_reason(F.col("gold"), answer, F.array(span)).alias("reason"))
    return d.select("doc_id", F.col("f.codes")[0].alias("code"), "f.changed", F.col("f.spans")[0]["text"].alias("text"), "reason")


@query("""with d as (select doc_id, text, doc_id * 7 % (length(text) - 12) as a from documents where length(text) > 12), p as (select *, substr(text, a + 1, 12) as part, translate(substr(text, a + 1, 12), ' .,', '_;:') as drifted from d)
select doc_id, case when doc_id % 3 = 2 then 'GENUINE' when doc_id % 3 = 1 and drifted <> part then 'FIXED' else 'OK' end as code, doc_id % 3 = 1 and drifted <> part as changed, case when doc_id % 3 = 2 then 'Ω' || substr(part, 2) else part end as text from p""")
def span_fixes_of_documents(spark, sf_dir):
    """Twelve characters of each whole document: as they are, with other punctuation, or with another first letter."""
    way, n = F.col("doc_id") % 3, F.length("text")
    d = _table(spark, sf_dir, "documents").where(n > 12).withColumn("a", (F.col("doc_id") * 7 % (n - 12)).cast("int"))
    part = F.substring("text", F.col("a") + 1, F.lit(12))
    said = F.when(way == 0, part).when(way == 1, F.translate(part, " .,", "_;:")).otherwise(F.concat(F.lit("Ω"), F.substring(part, 2, 12)))
    fix = tools.fixed_spans(F.col("text"), F.array(F.struct(F.col("a").alias("start"), (F.col("a") + 12).alias("end"), said.alias("text"))))
    return d.select("doc_id", fix.alias("f")).select("doc_id", F.col("f.codes")[0].alias("code"), "f.changed", F.col("f.spans")[0]["text"].alias("text"))
