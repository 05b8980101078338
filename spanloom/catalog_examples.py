"""Queries of the example and label operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.catalog import DIALOGUES_SQL, LABELLED_SQL, SPANS_SQL, _table, dialogues, labelled, query, span_pairs
from spanloom.operators import dialogue, examples, rows


def _pick(i, values):
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


@query(f"""with {DIALOGUES_SQL}, a as (select conv_id, messages as m, list_max(list_filter(range(0, len(messages)), lambda i: messages[i + 1].role = 'assistant')) as pos from dialogues), b as (select *, case when pos is null then m else list_slice(m, 1, pos) end as h from a),
c as (select *, coalesce(array_to_string(list_transform(h, lambda x: '### ?' || chr(10) || x.content), chr(10) || chr(10)), '') as t, coalesce(m[pos + 1].content, '') as ans from b)
select conv_id as dialogue_id, cast(len(h) as int) as n_history_turns, cast(conv_id % 2 as int) as n_spans, '## Tool definitions (from the assistant''s system prompt)' || chr(10) || 'tools' || chr(10) || chr(10) || '## Conversation history' || chr(10) || t || chr(10) || chr(10) || '## Assistant final answer (to analyze)' || chr(10) || ans || chr(10) || chr(10) || 'Analyze the final answer above for errors.' as asked,
case when conv_id % 2 = 0 then '{{"type": "clean", "spans": []}}' else '{{"type": "overgeneration", "spans": [{{"start": 2, "end": 5, "text": "a\\"b"}}]}}' end as target from c""")
def supervised_examples(spark, sf_dir):
    odd = F.col("conv_id") % 2 == 1
    span = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit('a"b').alias("text")))
    d = dialogues(spark, sf_dir).select(F.col("conv_id").alias("dialogue_id"), F.when(odd, "overgeneration").otherwise("clean").alias("type"), odd.cast("int").alias("label"), F.lit("s").alias("subset"), F.lit("tools").alias("system"), rows.marked_conversations(F.col("messages")).alias("conversations"), F.when(odd, span).otherwise(F.slice(span, 1, 0)).alias("span_labels"))
    return examples.supervised_examples(d, "system").select("dialogue_id", "n_history_turns", "n_spans", F.col("messages")[1]["content"].alias("asked"), F.col("messages")[2]["content"].alias("target"))


@query("""select doc_id, case doc_id % 5 when 0 then 'find({"n":' || doc_id || '})' when 1 then 'a({"x":"y"})' || chr(10) || '?({})' when 2 then 'plain ' || doc_id when 3 then '[1, 2]' else 'go({})' end as call,
case doc_id % 5 when 0 then null when 1 then null when 2 then 'no_json_object_found' when 3 then 'empty_output' else 'unbalanced_or_truncated_json' end as code from documents""")
def calls_and_codes(spark, sf_dir):
    i, way = F.col("doc_id"), F.col("doc_id") % 5
    calls = [F.concat(F.lit('{"arguments": {"n": '), i, F.lit('}, "name": "find"}')), F.lit('[{"name": "a", "arguments": {"x": "y"}}, {"nothing": 1}, 7]'), F.concat(F.lit("plain "), i), F.lit("[1, 2]"), F.lit('{"name": "go"}')]
    outputs = ['So: {"type": "clean"}', '```json\n{"type": null, "x": 1}\n```', "no object", " \n", 'see {"type": "cl']
    return _table(spark, sf_dir, "documents").select("doc_id", examples.call_text(F.get(F.array(*calls), way.cast("int"))).alias("call"), examples.prediction_code(_pick(way, outputs)).alias("code"))


@query("""select doc_id, cast(case when doc_id % 3 + doc_id % 2 > 0 then 1 else 0 end as int) as label, (doc_id % 5) / nullif(doc_id % 5 + doc_id % 3 + doc_id % 2, 0) as faithfulness_score, cast(doc_id % 5 as int) as supported_count, cast(doc_id % 3 as int) as unsupported_count, cast(doc_id % 2 as int) as contradicted_count,
array_to_string(list_transform(range(0, doc_id % 5), lambda i: 'supported (0.5): one') || list_transform(range(0, doc_id % 3), lambda i: 'unsupported (0.25): two') || list_transform(range(0, doc_id % 2), lambda i: 'contradicted (1.0): three'), chr(10) || chr(10)) as faithfulness_eval_text from documents""")
def sentence_tables(spark, sf_dir):
    i = F.col("doc_id")
    many = lambda label, score, sentence, n: F.array_repeat(F.struct(examples.support_label(F.lit(label)).alias("label"), F.lit(score).alias("score"), F.lit(sentence).alias("sentence")), n.cast("int"))
    items = F.concat(many(" LABEL_0", 0.5, "one", i % 5), many("Label_1", 0.25, "two", i % 3), many("Contradicted", 1.0, "three", i % 2))
    return examples.sentence_table(_table(spark, sf_dir, "documents").select("doc_id", items.alias("items")), "doc_id", "items")


@query(f"""with {SPANS_SQL} select doc_id, '[' || array_to_string(list_transform(pred, lambda s: '{{"start":' || s.start || ',"end":' || s."end" || '}}'), ',') || ']' as pred, '[' || array_to_string(list_transform(gold, lambda s: '{{"start":' || s.start || ',"end":' || s."end" || '}}'), ',') || ']' as gold from pairs where doc_id in (select doc_id from labels)""")
def paired_spans(spark, sf_dir):
    gold = span_pairs(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return examples.paired(span_pairs(spark, sf_dir), gold, "doc_id", "pred", "gold")


@query("""with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents), p as (select *, doc_id * 7 % (n + 1) as a from t), q as (select *, a + doc_id * 13 % (n - a + 1) as b from p)
select doc_id, text as plain, cast(a as int) as start, cast(b as int) as "end", substr(text, a + 1, b - a) as shown, 'v' || doc_id as source_value, substr(text, a + 1, b - a) as value from q""")
def tagged_values(spark, sf_dir):
    """A part of each whole document in a data tag, and the same part in a key tag."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n, i = F.length("t"), F.col("doc_id")
    a = i * 7 % (n + 1)
    b = a + i * 13 % (n - a + 1)
    cut = lambda x, y: F.substring("t", (x + 1).cast("int"), (y - x).cast("int"))
    zero, end = F.lit(0), n
    data = F.concat(cut(zero, a), F.lit('<DATA  val="v'), i, F.lit('">'), cut(a, b), F.lit("</DATA>"), cut(b, end))
    key = F.concat(cut(zero, a), F.lit("[k_1]"), cut(a, b), F.lit("[/k_1]"), cut(b, end))
    d = d.select("doc_id", examples.data_spans(data).alias("x"), examples.key_spans(key).alias("y"))
    one, two = F.col("x.spans")[0], F.col("y.spans")[0]
    return d.select("doc_id", F.col("y.text").alias("plain"), one["start"].alias("start"), one["end"].alias("end"), one["text"].alias("shown"), one["source_value"].alias("source_value"), two["value"].alias("value"))


@query("""with k as (select o_orderkey, o_orderkey % 6 as way, cast(floor(o_totalprice) as bigint) as p from orders), f as (select *, regexp_replace(cast(p as varchar), '(\\d)(\\d{3})$', '\\1,\\2') as c from k)
select o_orderkey, case way when 0 then 'x ' || p when 1 then 'x ' || c when 2 then 'x ' || c || '.50' when 3 then 'x Ab' || p when 4 then 'x 2024-05-06' end as found, cast(case when way < 5 then 0 end as int) as start from f""")
def located_values(spark, sf_dir):
    """Prices in answers that write them with commas, in another case, or dates without time; the sixth way isn't there at all."""
    price, way = F.floor("o_totalprice").cast("bigint"), F.col("o_orderkey") % 6
    shown = F.regexp_replace(price.cast("string"), r"(\d)(\d{3})$", "$1,$2")
    value = F.get(F.array(price.cast("string"), price.cast("string"), F.concat(price, F.lit(".50")), F.concat(F.lit("aB"), price), F.lit("2024-05-06T10:00"), F.lit("absent!")), way.cast("int"))
    commas = F.format_number(price, 0)
    answer = F.get(F.array(price.cast("string"), commas, F.concat(commas, F.lit(".50")), F.concat(F.lit("Ab"), price), F.lit("2024-05-06"), F.lit("nothing here")), way.cast("int"))
    d = _table(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer"), examples.located(F.concat(F.lit("x "), answer), value).alias("l"), shown.alias("s"), way.alias("way"))
    return d.select("o_orderkey", F.when(F.col("l").isNotNull(), F.concat(F.lit("x "), F.when(F.col("way").isin(1, 2), F.concat("s", F.when(F.col("way") == 2, ".50").otherwise(""))).otherwise(F.col("l.text")))).alias("found"), (F.col("l.start") - 2).alias("start"))


@query(f"""with {SPANS_SQL}, t as (select doc_id, coalesce(text, '') as text from documents), p as (select * from pairs join t using (doc_id)) select doc_id, coalesce(len(list_filter(gold, lambda s: 2 * (s."end" - s.start) >= length(text))) > 0 and length(text) > 0, false) as half,
cast(gold[1].start - length(list_last(string_split(substr(text, 1, gold[1].start), chr(10)))) as int) as line_start, cast(gold[1]."end" + length(string_split(substr(text, gold[1]."end" + 1), chr(10))[1]) as int) as line_end from p""")
def span_lines(spark, sf_dir):
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = span_pairs(spark, sf_dir).join(texts, "doc_id")
    one = F.get("gold", 0)
    line = examples.whole_lines(F.col("text"), one["start"].cast("int"), one["end"].cast("int"))
    return d.select("doc_id", examples.covers_half(F.col("gold"), F.col("text")).alias("half"), line["start"].alias("line_start"), line["end"].alias("line_end"))


@query(f"""with {LABELLED_SQL} select doc_id, doc_id % 3 = 0 or (doc_id % 3 = 2 and doc_id % 4 in (1, 3)) as flawed, doc_id % 4 in (1, 3) as elsewhere, case when doc_id % 5 <> 0 then cast(case when doc_id % 3 = 1 or doc_id % 4 in (0, 2) then 0 else 1 end as int) end as n_labels from labelled""")
def label_filters(spark, sf_dir):
    """Rows by a flag (two of three), or by their labels: none, one inside, one implicit at the end, one inside beside a bad one. Every fifth row has no output and no sample."""
    i = F.col("doc_id")
    label = lambda a, b, yes=False: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(yes).alias("implicit_true"))
    labels = F.when(i % 4 == 0, F.slice(F.array(label(0, 1)), 1, 0)).when(i % 4 == 1, F.array(label(0, 3))).when(i % 4 == 2, F.array(label(0, 6, True))).otherwise(F.array(label(1, 2), label(5, 5)))
    flag = F.when(i % 3 == 0, 1).when(i % 3 == 1, 0)
    d = labelled(spark, sf_dir).select("doc_id", labels.alias("labels"), flag.alias("flag"), F.when(i % 5 != 0, "output").otherwise("").alias("output"), F.lit("q").alias("query"), F.lit("c").alias("context"), F.col("doc_id").cast("string").alias("task_type"))
    samples = examples.tagger_samples(d, "made").select(F.col("task_type").cast("bigint").alias("doc_id"), F.size("labels").alias("n_labels"))
    return d.select("doc_id", examples.is_flawed(F.col("flag"), F.col("labels")).alias("flawed"), examples.ends_elsewhere(F.lit("output"), F.col("labels")).alias("elsewhere")).join(samples, "doc_id", "left")


@query("with c as (select conv_id, count(*) filter (where role = 'assistant' and turn % 4 = 1) as n from conversations group by conv_id) select conv_id from c where n = 1")
def single_call_dialogues(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "tool_call").otherwise(F.col("role"))
    d = dialogue.gather(c.withColumn("role", role), "conv_id", "turn", "role", "text")
    return d.where(examples.single_call(F.col("messages"), lambda m: m["role"] == "tool_call")).select("conv_id")
