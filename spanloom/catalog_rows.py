"""Queries of the scoring and row operators over views derived from the driver's tables, and their SQL.

The views write predictions in the ways models write them; the SQL says what each way means, from the numbers the view was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.catalog import CLASSES, DIALOGUES_SQL, LABELLED_SQL, SHARES_SQL, SPANS_SQL, _table, dialogues, labelled, query, span_pairs
from spanloom.functions import cleanup, text
from spanloom.operators import dialogue, metrics, rows, scoring, spans

SPELLINGS = ("Correct", " clean ", "ok", "none", "no-hallucination", "answer-mismatch", "answer_missmatch", "MISMATCH", "contradiction", "am", "singlehop_overgeneration", "overgen", "og", "multihop-missing_tool", "Missing Tool", "mt", "Undergeneration", "undergen", "ug", "singlehop_multihop_ok", "other thing", "", "over", "supported")
MEANT = ("clean",) * 5 + ("answer_mismatch",) * 5 + ("overgeneration",) * 3 + ("missing_tool",) * 3 + ("undergeneration",) * 3 + ("clean", "other thing", "", "over", "supported")


def _sql_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _nth(names: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))


@query(f"select doc_id, case when doc_id % 25 = 24 then null else ({_sql_list(MEANT)})[cast(doc_id % 25 + 1 as int)] end as kind from documents")
def normalize_types(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", metrics.normalize_type(_nth(SPELLINGS, F.col("doc_id") % 25)).alias("kind"))


def _policy_sql(policy: str) -> str:
    pool = "gold <> 'clean'" if policy != "exclude" else "gold not in ('clean', 'undergeneration')"
    here = "true" if policy != "exclude" else "gold <> 'undergeneration'"
    scored = "true" if policy == "score" else "c <> 'undergeneration'"
    return f"""select '{policy}' as policy, c as class,
      case when c = 'clean' then count(*) filter (where gold = 'clean' and not flagged) when {scored} then count(*) filter (where gold = c and flagged) end as tp,
      case when c = 'clean' then count(*) filter (where gold not in ('clean', 'undergeneration') and not flagged) when {scored} then count(*) filter (where gold = 'clean' and flagged) end as fp,
      case when c = 'clean' then count(*) filter (where gold = 'clean' and flagged) when {scored} then count(*) filter (where gold = c and not flagged) end as fn,
      count(*) filter (where gold = c) as support, count(*) filter (where gold = c and flagged) / nullif(count(*) filter (where gold = c), 0) as flag_rate from labelled, k group by c
    union all select '{policy}', 'ALL', count(*) filter (where {pool} and flagged), count(*) filter (where gold = 'clean' and flagged), count(*) filter (where {pool} and not flagged), count(*) filter (where {pool}), count(*) filter (where {here} and flagged) / count(*) filter (where {here}) from labelled"""


@query(f"with {LABELLED_SQL}, k as (select unnest({CLASSES}) as c), r as ({' union all '.join(_policy_sql(p) for p in ('exclude', 'positive', 'score'))}) select policy, class, tp, fp, fn, support, flag_rate, case when tp is not null then coalesce(tp / nullif(tp + fp, 0), 0.0) end as \"precision\", case when tp is not null then coalesce(tp / nullif(tp + fn, 0), 0.0) end as recall, case when tp is not null then coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) end as f1 from r")
def detection_policies(spark, sf_dir):
    d = labelled(spark, sf_dir)
    reports = [metrics.detection_report(d, undergeneration=p).withColumn("policy", F.lit(p)) for p in ("exclude", "positive", "score")]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def raw_predictions(spark, sf_dir) -> DataFrame:
    """Spans of documents written in eight ways."""
    d = span_pairs(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    word = lambda s: spans.cut(F.col("text"), s["start"], s["end"])
    d = d.withColumn("w", F.transform("pred", word))
    listed = F.transform("pred", lambda s: F.to_json(F.struct(s["start"], s["end"], word(s).alias("text"))))
    joined = lambda parts: F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    inside = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    forms = [
        joined(listed),
        F.to_json(F.struct(F.transform("pred", lambda s: F.struct(s["start"], s["end"])).alias("spans"))),
        F.concat(F.lit('{"predictions": '), joined(F.transform("pred", lambda s: F.concat(F.lit("["), s["start"], F.lit(","), s["end"], F.lit(","), inside(word(s)), F.lit("]")))), F.lit("}")),
        F.to_json("w"),
        joined(F.transform("pred", lambda s: F.to_json(F.struct(word(s).alias("span"), F.lit("og").alias("class"), s["start"].cast("string").alias("start"), (s["end"] + 0.5).alias("end"))))),
        F.to_json(listed),
        F.lit("plain words"),
    ]
    way = F.col("doc_id") % 8
    return d.select("doc_id", "text", "pred", F.get(F.array(*forms), way.cast("int")).alias("raw"))


@query(f"""with {SPANS_SQL}, p as (select doc_id, coalesce(text, '') as text, pred, doc_id % 8 as way from pairs join (select doc_id, text from documents) using (doc_id)), s as (select doc_id, way, text, unnest(pred) s from p),
w as (select doc_id, way, cast(s.start as int) as a, cast(s."end" as int) as b, nullif(substr(text, s.start + 1, s."end" - s.start), '') as t from s)
select doc_id, case when way in (0, 1, 2, 4, 5) then a end as start, case when way in (0, 1, 2, 4, 5) then b end as "end", case when way <> 1 then t end as text, case when way = 4 then 'og' end as label_type from w where way < 6 and (way <> 3 or regexp_matches(t, '\\S'))
union all select doc_id, null, null, 'plain words', null from p where way = 6""")
def parsed_spans(spark, sf_dir):
    return raw_predictions(spark, sf_dir).select("doc_id", F.explode(scoring.parse_span_list("raw")).alias("s")).select("doc_id", "s.*")


@query("""select doc_id, case when doc_id % 7 = 6 or doc_id % 7 = 5 then null else case doc_id % 7 when 0 then ['clean'] when 1 then ['overgeneration', 'missing_tool'] when 2 then ['answer_mismatch'] when 3 then ['undergeneration'] when 4 then ['other'] end end as classes, doc_id % 7 in (5, 6) as failed,
cast(case doc_id % 7 when 1 then 1 when 2 then 1 when 5 then 1 else 0 end as int) as n_spans from documents""")
def predicted_classes(spark, sf_dir):
    way = F.col("doc_id") % 7
    kinds = ["ok", '["og", {"class": "Missing Tool"}, "overgen"]', '{"type": "am"}', "ug", "made up", "unknown", "clean"]
    spoken = ["[]", '[{"text": "x"}]', "x", None, "[{}]", '["y"]', '["z"]']
    d = _table(spark, sf_dir, "documents").select("doc_id", _nth(tuple(kinds), way).alias("kind"), F.get(F.array(*[F.lit(x) for x in spoken]), way.cast("int")).alias("spoken"), F.when(way == 6, "error").otherwise("ok").alias("status"))
    p = scoring.predicted("status", "kind", "spoken")
    return d.select("doc_id", p["classes"].alias("classes"), p["failed"].alias("failed"), F.size(p["spans"]).alias("n_spans"))


@query("""with b as (select item_id, text, cast(item_id * 7 % greatest(length(text) - 12, 1) as int) as s, item_id % 5 as way, item_id * 3 % length(text) as a from benchmark where length(text) > 20),
c as (select *, substr(text, s + 1, 6) as q from b), o as (select *, list_filter(range(0, length(text) - 5), lambda i: substr(text, i + 1, 6) = q) as places from c),
n as (select *, list_position(list_transform(places, lambda i: abs(i - a)), list_min(list_transform(places, lambda i: abs(i - a)))) as k from o)
select item_id, cast(case way when 0 then s when 1 then places[k] when 2 then s when 3 then null else places[1] end as int) as start, cast(case way when 0 then s + 6 when 1 then places[k] + 6 when 2 then s + 6 when 3 then null else places[1] + 6 end as int) as "end", case way when 3 then 'not in it ~' else q end as text,
case when way = 0 or (way = 1 and places[k] = a) then null when way in (1, 4) then 'MOVED 0' when way = 2 then 'OFFSETS_USED 0' when way = 3 then 'UNPLACED 0' end as issue from n""")
def anchored_predictions(spark, sf_dir):
    d = _table(spark, sf_dir, "benchmark").where(F.length("text") > 20)
    i, n = F.col("item_id"), F.length("text")
    s, way = (i * 7 % F.greatest(n - 12, F.lit(1))).cast("int"), i % 5
    q = spans.cut(F.col("text"), s, s + 6)
    a = (i * 3 % n).cast("int")
    start = F.when(way.isin(0, 2), s).when(way == 1, a)
    raw = F.array(F.struct(start.cast("int").alias("start"), F.when(way == 1, a + 6).otherwise(start + 6).cast("int").alias("end"), F.when(way.isin(2, 3), "not in it ~").otherwise(q).alias("text"), F.lit(None).cast("string").alias("label_type")))
    d = d.select("item_id", scoring.validated(F.lit("overgeneration"), raw, F.col("text")).alias("v"))
    one = F.get(F.col("v.spans"), 0)
    return d.select("item_id", one["start"].alias("start"), one["end"].alias("end"), one["text"].alias("text"), F.get(F.col("v.issues"), 0).alias("issue"))


COUNTED_SQL = "counted as (select *, doc_id % 2 as matched, doc_id % 2 + doc_id % 3 as n_pred, doc_id % 2 + doc_id % 5 as n_gold, doc_id % 4 // 3 as unlocatable, case when doc_id % 6 = 0 then null when doc_id % 5 = 0 then [pred, 'missing_tool'] else [pred] end as preds, doc_id % 6 = 0 as failed from labelled)"


def counted(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    preds = F.when(i % 6 == 0, None).when(i % 5 == 0, F.array("pred", F.lit("missing_tool"))).otherwise(F.array("pred"))
    return labelled(spark, sf_dir).withColumns({"matched": i % 2, "n_pred": i % 2 + i % 3, "n_gold": i % 2 + i % 5, "unlocatable": F.floor(i % 4 / 3), "preds": preds, "failed": i % 6 == 0})


def _f1_sql(tp: str, fp: str, fn: str) -> str:
    return f"coalesce(2 * ({tp}) / nullif(2 * ({tp}) + ({fp}) + ({fn}), 0), 0.0)"


def _where(agg: str, cond: str) -> str:
    return f"coalesce({agg} filter (where {cond}), 0)"


def _table_sql() -> str:
    none = "gold not in ('clean', 'undergeneration')"
    resp = {"clean": _f1_sql("count(*) filter (where gold = 'clean' and not flagged)", f"count(*) filter (where {none} and not flagged)", "count(*) filter (where gold = 'clean' and flagged)")}
    span = {}
    for c in metrics.DEFECTS:
        resp[c] = _f1_sql(f"count(*) filter (where gold = '{c}' and flagged)", "count(*) filter (where gold = 'clean' and flagged)", f"count(*) filter (where gold = '{c}' and not flagged)")
    for c in (*metrics.SPAN_CLASSES, "ALL"):
        here = "true" if c == "ALL" else f"gold = '{c}'"
        span[c] = _f1_sql(_where("sum(matched)", here), _where("sum(n_pred - matched + unlocatable)", here), _where("sum(n_gold - matched)", here))
    four = lambda x, name: f'round({x}, 4) as "{name}"'
    parts = ["'Transfer SFT' as \"Setting\"", "'labels' as \"Data\"", "'arithmetic' as \"Model\"", "'class-aware' as \"Detector\""]
    parts += [four(resp[c], name) for name, c in scoring.TABLE]
    parts.append(four("(" + " + ".join(resp[c] for c in ("clean", *metrics.SPAN_CLASSES)) + ") / 4", "Response-level Avg. (w/o Undergen.)"))
    parts.append(four("count(*) filter (where gold <> 'clean' and list_contains(preds, gold)) / count(*) filter (where gold <> 'clean' and preds is not null)", "Type Acc."))
    parts += [four(span[c], name) for name, c in scoring.SPAN_TABLE]
    parts += [four("(" + " + ".join(span[c] for c in metrics.SPAN_CLASSES) + ") / 3", "Span-level Avg. (macro)"), four(span["ALL"], "Span-level ALL (pooled)")]
    parts.append("""'scored (' || count(*) filter (where gold = 'undergeneration') || ')' as "Undergen. rows" """)
    parts.append("""count(*) || ' resp / ' || count(*) || ' span' as "Scored rows" """)
    return f"with {LABELLED_SQL}, {COUNTED_SQL} select {', '.join(parts)} from counted"


@query(_table_sql())
def results_table(spark, sf_dir):
    return scoring.table_row(counted(spark, sf_dir), "score", data="labels", model="arithmetic", detector="class-aware")


@query(f"""with {LABELLED_SQL}, {COUNTED_SQL}, s as (select case when gold = 'clean' then 'clean(FP source)' else gold end as scope, * from counted), r as (select coalesce(scope, 'ALL') as scope, sum(matched) tp, sum(n_pred - matched + unlocatable) fp, sum(n_gold - matched) fn, count(*) support_rows, sum(n_gold) gold_spans, sum(n_pred + unlocatable) pred_spans, sum(unlocatable) unlocatable_spans, avg(doc_id % 3 / 2) c, avg(doc_id % 5 / 4) t, avg(doc_id % 2) e from s group by rollup (scope))
select scope, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, support_rows, cast(gold_spans as bigint) gold_spans, cast(pred_spans as bigint) pred_spans, cast(unlocatable_spans as bigint) unlocatable_spans, case when scope in ('answer_mismatch', 'overgeneration', 'missing_tool') then c end as char_f1, case when scope in ('answer_mismatch', 'overgeneration', 'missing_tool') then t end as token_f1, case when scope in ('answer_mismatch', 'overgeneration', 'missing_tool') then e end as exact, {SHARES_SQL} from r""")
def span_scopes(spark, sf_dir):
    i = F.col("doc_id")
    return scoring.span_scopes(counted(spark, sf_dir).withColumns({"char_f1": i % 3 / 2, "token_f1": i % 5 / 4, "exact": i % 2 == 1}))


@query(f"""with {LABELLED_SQL}, {COUNTED_SQL}, t as (select * from counted where preds is not null), k as (select unnest({CLASSES}) as c), r as (select c, count(*) filter (where gold = c and list_contains(preds, c)) tp, count(*) filter (where list_contains(preds, c)) p, count(*) filter (where gold = c) n from t, k group by c)
select avg(coalesce(2 * tp / nullif(p + n, 0), 0)) filter (where n > 0) as macro_f1, sum(tp) filter (where c <> 'clean') / sum(n) filter (where c <> 'clean') as type_accuracy, {", ".join(f"max(tp / nullif(n, 0)) filter (where c = '{c}') as type_accuracy_{c}" for c in metrics.DEFECTS)}, (select count(*) from t where len(preds) > 1) as several_classes, (select count(*) from t where failed) as parse_failures from r""")
def class_summary(spark, sf_dir):
    return scoring.class_summary(counted(spark, sf_dir))


CHARS_SQL = f"""{LABELLED_SQL}, {SPANS_SQL}, chars as (select l.*, p.pred as ps, p.gold as gs, list_distinct(flatten(list_transform(p.pred, lambda s: range(s.start, s."end")))) as a, list_distinct(flatten(list_transform(p.gold, lambda s: range(s.start, s."end")))) as b from labelled l join (select doc_id, pred, gold from pairs) p using (doc_id)), n as (select *, len(a) as na, len(b) as nb, len(list_intersect(a, b)) as c from chars)"""


def with_spans(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir).join(span_pairs(spark, sf_dir).select("doc_id", F.col("pred").alias("pred_spans"), F.col("gold").alias("gold_spans")), "doc_id")


@query(f"""with {CHARS_SQL}, h as (select *, na = nb and na = c as same from n where gold <> 'clean' and len(gs) > 0), x as (select unnest(['ALL', case when gold = pred then 'TYPE_CORRECT' end, gold]) as scope, * from h), r as (select scope, sum(c) tp, sum(na - c) fp, sum(nb - c) fn, count(*) filter (where same) as exact, count(*) n from x where scope is not null group by scope)
select scope, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, exact, n, {SHARES_SQL} from r""")
def char_scopes(spark, sf_dir):
    return scoring.char_scopes(with_spans(spark, sf_dir))


@query(f"with {CHARS_SQL} select count(*) filter (where gold = 'clean' or len(gs) = 0) as n_clean, count(*) filter (where (gold = 'clean' or len(gs) = 0) and na > 0) as clean_false_positive_rows, cast(sum(doc_id % 3) as bigint) as unplaceable_spans from n")
def clean_flags(spark, sf_dir):
    return scoring.clean_flags(with_spans(spark, sf_dir).withColumn("unplaceable", F.col("doc_id") % 3))


@query(f"with {CHARS_SQL} select avg(case when na + nb = 0 then 1 else coalesce(c / nullif(na, 0), 0) end) as mean_precision, avg(case when na + nb = 0 then 1 else coalesce(c / nullif(nb, 0), 0) end) as mean_recall, avg(case when na + nb = 0 then 1 else 2 * c / (na + nb) end) as mean_f1, count(*) as n from n")
def mean_characters(spark, sf_dir):
    return scoring.mean_characters(with_spans(spark, sf_dir))


@query(f"""with {LABELLED_SQL}, {SPANS_SQL}, e as (select l.*, case when l.doc_id % 9 = 0 then 'clean' else l.pred end as said, list_distinct(flatten(list_transform(p.pred, lambda s: range(greatest(s.start, 0), least(s."end", l.n_chars // 2))))) as a, list_distinct(flatten(list_transform(p.gold, lambda s: range(greatest(s.start, 0), least(s."end", l.n_chars // 2))))) as b from labelled l join (select doc_id, pred, gold from pairs) p using (doc_id)),
n as (select *, len(a) as na, len(b) as nb, len(list_intersect(a, b)) as c from e), k as (select unnest({CLASSES}) as k), r as (select k, count(*) filter (where gold = k and said = k) tp, count(*) filter (where gold <> k and said = k) fp, count(*) filter (where gold = k and said <> k) fn from n, k group by k), m as (select sum(tp) tp, avg(coalesce(tp / nullif(tp + fn, 0), 0)) bal, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) f1 from r)
select count(*) as n, count(*) filter (where doc_id % 9 = 0) as parse_fail, (select tp from m) / count(*) as fine_accuracy, (select bal from m) as balanced_accuracy, (select f1 from m) as macro_f1, count(*) filter (where (gold = 'clean') = (said = 'clean')) / count(*) as binary_accuracy,
2 * count(*) filter (where gold <> 'clean' and said <> 'clean') / (2 * count(*) filter (where gold <> 'clean' and said <> 'clean') + count(*) filter (where (gold = 'clean') <> (said = 'clean'))) as binary_f1, sum(c) / sum(na) as char_precision, sum(c) / sum(nb) as char_recall, 2 * sum(c) / (sum(na) + sum(nb)) as char_f1, avg(c / (na + nb - c)) filter (where nb > 0) as span_mean_iou, count(*) filter (where nb > 0) as span_iou_rows from n""")
def overall_scores(spark, sf_dir):
    d = with_spans(spark, sf_dir)
    lost = F.col("doc_id") % 9 == 0
    return scoring.overall_score(d.withColumns({"pred": F.when(~lost, F.col("pred")), "parsed": ~lost, "length": F.floor(F.col("n_chars") / 2)}))


TOOLED_SQL = """t as (select conv_id, turn, case when role = 'user' and turn % 4 = 2 then 'tool' else lower(trim(role)) end as role, coalesce(text, '') as content from conversations), dialogues as (select conv_id, list({'role': role, 'content': content} order by turn) as m from t group by conv_id)"""


def tooled(spark, sf_dir) -> DataFrame:
    """Dialogues of which some user messages are made tool messages."""
    c = _table(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 2), "tool").otherwise(F.col("role"))
    return dialogue.gather(c.withColumn("role", role), "conv_id", "turn", "role", "text")


def _last(m: str, upto: str, role: str) -> str:
    return f"list_max(list_filter(range(0, {upto}), lambda i: {m}[i + 1].role = '{role}'))"


@query(f"""with {TOOLED_SQL}, f as (select conv_id, list_filter(m, lambda x: x.role in ('user', 'assistant', 'tool')) as m from dialogues), a as (select *, list_max(list_filter(range(0, len(m) - 1), lambda i: m[i + 1].role = 'tool' and m[i + 2].role = 'assistant')) as tool from f), b as (select *, {_last('m', 'tool', 'assistant')} as call from a), c as (select *, {_last('m', 'call', 'user')} as q from b where call is not null),
d as (select *, list_filter(range(0, q), lambda i: m[i + 1].role = 'user') as us from c where q is not null)
select conv_id, m[q + 1].content as query, m[call + 1].content as tool_call, m[tool + 1].content as tool_response, m[tool + 2].content as answer, cast(q as int) as n_before, cast(case when len(us) > 2 then q - us[-2] else q end as int) as n_history from d""")
def conversation_samples(spark, sf_dir):
    d = tooled(spark, sf_dir).select("conv_id", rows.conversation_sample(F.col("messages"), 2).alias("s")).where("s is not null")
    return d.select("conv_id", "s.query", "s.tool_call", "s.tool_response", "s.answer", F.size("s.full_history").alias("n_before"), F.size("s.history").alias("n_history"))


@query(f"""with {TOOLED_SQL}, a as (select *, case when conv_id % 2 = 0 then {_last('m', 'len(m)', 'assistant')} else list_min(list_filter(range(0, len(m)), lambda i: m[i + 1].role = 'assistant')) end as pos from dialogues), b as (select *, {_last('m', 'pos', 'user')} as u from a where pos is not null)
select conv_id, coalesce(m[u + 1].content, '') as question, m[pos + 1].content as answer, list_aggregate(list_transform(list_filter(list_slice(m, coalesce(u, -1) + 2, pos), lambda x: x.role = 'tool'), lambda x: x.content), 'string_agg', '|') as tools from b""")
def exported_turns(spark, sf_dir):
    """Every second dialogue has its last assistant message marked as the final answer; the others have no mark."""
    marked = rows.marked_conversations(F.col("messages"))
    bare = F.transform(marked, lambda t: F.struct(t["from"], t["value"], F.lit("").alias("turn_role")))
    d = tooled(spark, sf_dir).select("conv_id", rows.exported_turn(F.when(F.col("conv_id") % 2 == 0, marked).otherwise(bare)).alias("t")).where("t is not null")
    return d.select("conv_id", "t.question", "t.answer", F.when(F.size("t.tool_values") > 0, F.array_join("t.tool_values", "|")).alias("tools"))


@query(f"""with {TOOLED_SQL}, a as (select *, {_last('m', 'len(m)', 'assistant')} as pos from dialogues), b as (select *, case when pos is not null then {_last('m', 'pos', 'user')} end as u from a), c as (select *, list_transform(list_filter(list_slice(m, coalesce(u, -1) + 2, pos), lambda x: x.role = 'tool'), lambda x: x.content) as tools from b)
select conv_id as dialogue_id, case when pos is not null then coalesce(m[u + 1].content, '') end as query, case when pos is not null then coalesce(array_to_string(tools, chr(10) || chr(10)), '') end as context, m[pos + 1].content as output, 'clean' as gold_type, cast(conv_id % 2 as int) as gold_label, 'test' as row_split, cast(2 as int) as n_gold from c""")
def target_examples(spark, sf_dir):
    span = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"), F.lit(None).cast("string").alias("text"))
    d = tooled(spark, sf_dir).select(F.col("conv_id").alias("dialogue_id"), rows.marked_conversations(F.col("messages")).alias("conversations"), F.lit("clean").alias("type"), (F.col("conv_id") % 2).cast("int").alias("label"), F.array(span(0, 3), span(5, 5), span(None, 2), span(4, 9)).alias("span_labels"), F.lit("test").alias("split"))
    return rows.target_examples(d).withColumn("n_gold", F.size("gold_spans")).drop("contexts", "gold_spans")


@query(f"""with {DIALOGUES_SQL}, a as (select conv_id, messages as m, {_last('messages', 'len(messages)', 'assistant')} as pos from dialogues), b as (select *, case when pos is not null then m[pos + 1].content end as ans, conv_id % 6 as k from a), c as (select *, instr(substr(ans, 2), substr(ans, 1, 9)) = 0 as once from b)
select cast(conv_id as varchar) as dialogue_id, case k when 0 then 'clean' when 1 then 'answer_mismatch' when 2 then 'overgeneration' when 3 then 'missing_tool' when 4 then 'undergeneration' end as type, cast(case k when 0 then 0 when 5 then null else 1 end as int) as label, case when k = 5 then 'UNKNOWN_CLASS' when ans is null then 'NO_FINAL_ANSWER' when trim(ans) = '' then 'EMPTY_ANSWER' end as code,
cast(case when k in (1, 2) and length(ans) >= 9 then 1 else 0 end as int) as n_spans from c where ans is null or length(ans) < 9 or once or k <> 2""")
def unified_rows(spark, sf_dir):
    """Spans as they stand (class 1), moved to their only place (class 2), and with no place at all (class 3); rows where the moved text stands twice are left out."""
    d = dialogues(spark, sf_dir)
    at = dialogue.last_index(F.col("messages"), lambda m: m["role"] == "assistant")
    d = d.withColumn("ans", F.get("messages", at)["content"]).withColumn("k", F.col("conv_id") % 6)
    head = F.substring("ans", 1, 9)
    d = d.where(F.col("ans").isNull() | (F.length("ans") < 9) | ~F.expr("substr(ans, 2)").contains(head) | (F.col("k") != 2))
    start = F.when(F.col("k") == 2, 40_000).otherwise(0)
    span = F.struct(start.alias("start"), (start + 9).alias("end"), F.when(F.col("k") == 3, "~ not there ~").otherwise(head).alias("text"))
    raw = F.when(F.length("ans") >= 9, F.array(span)).otherwise(F.slice(F.array(span), 1, 0))
    made = _nth(tuple(rows.MADE_CLASSES) + ("strange",), F.col("k"))
    none = F.lit(None).cast("string")
    d = d.select(made.alias("class"), F.col("messages").alias("full"), raw.alias("spans"), none.alias("sample_id"), F.col("conv_id").alias("id"), *[none.alias(c) for c in ("system_prompt", "tool_call", "tool_response", "original_tool_response", "omitted_items")])
    return rows.unified_rows(d, "test").select("dialogue_id", "type", "label", "code", F.size("span_labels").alias("n_spans"))


@query(f"""with {LABELLED_SQL}, v as (select *, case doc_id % 5 when 0 then 'pass' when 1 then 'fail' when 2 then 'uncertain' when 3 then 'fail' end as judged from labelled),
o as (select *, case when judged is null then 'missing_or_error' when judged <> 'fail' then judged when doc_id % 5 = 1 and gold in ('answer_mismatch', 'overgeneration', 'missing_tool') and doc_id % 3 <> 0 then 'fail_rescued_spans' else 'fail' end as outcome from v)
select doc_id as dialogue_id, gold as type, outcome, outcome in ('pass', 'fail_rescued_spans', 'missing_or_error') as keep, cast(case when outcome = 'fail_rescued_spans' then 4 when gold in ('clean', 'undergeneration') then null else 0 end as int) as start from o""")
def judged_rows(spark, sf_dir):
    i, gold = F.col("doc_id"), F.col("gold")
    base = labelled(spark, sf_dir)
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("the ").alias("text")))
    d = base.select(i.alias("dialogue_id"), gold.alias("type"), (gold != "clean").cast("int").alias("label"), F.lit("the answer of the day").alias("answer"), F.when(gold.isin(*metrics.SPAN_CLASSES), first).otherwise(none).alias("span_labels"))
    suggested = F.when(i % 3 == 0, F.array(F.lit("the "))).otherwise(F.array(F.lit("answer"), F.lit("day")))
    v = base.where(i % 5 != 4).select(i.alias("dialogue_id"), gold.alias("stored_type"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), F.when(i % 5 == 0, "pass").when(i % 5 == 2, "uncertain").otherwise("fail").alias("row_judgment"), (i % 5 == 1).alias("type_is_correct"), (gold != "clean").alias("hallucination_present"), suggested.alias("suggested"))
    v = v.withColumn("row_judgment", F.when(F.col("line") == 1, "pass").otherwise(F.col("row_judgment")))  # the last line counts
    out = rows.judged_rows(d, v, "line", rescue=True)
    return out.select("dialogue_id", "type", "outcome", "keep", F.get("span_labels", 0)["start"].alias("start"))


@query("""with d as (select doc_id, doc_id % 6 as k, doc_id % 4 as j from documents) select doc_id, k <> 4 and k <> 5 as valid, case k when 4 then 'BAD_JUDGMENT' when 5 then 'BAD_TYPE' end as reason, case when k = 3 then 'answer_mismatch' when k = 5 then 'nonsense' else 'clean' end as recommended_type, j = 0 or doc_id % 2 = 0 as span_labels_are_correct, cast(case when j = 0 then 0 else 1 end as int) as n_suggested, cast(case when j = 0 then 1 + cast(doc_id % 2 <> 0 as int) else 0 end as int) as n_warnings from d""")
def checked_verdicts(spark, sf_dir):
    i = F.col("doc_id")
    k, j = i % 6, i % 4
    v = F.struct(F.when(k == 4, "maybe").otherwise("pass").alias("row_judgment"), F.when(k == 3, "answer_missmatch").when(k == 5, "nonsense").otherwise("clean").alias("recommended_type"), F.lit(True).alias("hallucination_present"), F.lit(True).alias("type_is_correct"), (i % 2 == 0).alias("span_labels_are_correct"), F.array(F.lit("x")).alias("suggested"))
    d = _table(spark, sf_dir, "documents").select("doc_id", rows.checked_verdict(v, F.when(j == 0, "undergeneration").otherwise("missing_tool"), F.lit(0)).alias("c"))
    return d.select("doc_id", "c.valid", "c.reason", "c.recommended_type", "c.span_labels_are_correct", F.size("c.suggested").alias("n_suggested"), F.size("c.warnings").alias("n_warnings"))


@query(f"""with {LABELLED_SQL}, c as (select unnest([case when gold = 'missing_tool' then 'BAD_TYPE' end, case when (doc_id % 7 = 0) <> (gold = 'clean') then 'LABEL_TYPE_MISMATCH' end, case when doc_id % 5 = 0 then 'NO_FINAL_ANSWER' end, case when doc_id % 5 <> 0 and gold in ('clean', 'undergeneration') and doc_id % 3 <> 0 then 'EMPTY_SPANS_REQUIRED' end, case when doc_id % 5 <> 0 and gold in ('answer_mismatch', 'overgeneration') and doc_id % 3 = 0 then 'SPANS_REQUIRED' end, case when doc_id % 5 <> 0 and doc_id % 3 = 1 then 'SPAN_OOR' end, case when doc_id % 5 <> 0 and doc_id % 3 = 2 then 'SPAN_INVARIANT' end]) as code from labelled) select code, count(*) as n from c where code is not null group by code""")
def row_codes(spark, sf_dir):
    i = F.col("doc_id")
    kind = F.when(F.col("gold") == "missing_tool", "no such").otherwise(F.col("gold"))
    span = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text"))
    labels = F.when(i % 3 == 0, F.slice(F.array(span(0, 3, "one")), 1, 0)).when(i % 3 == 1, F.array(span(0, 3, "one"), span(2, 99, "x"))).otherwise(F.array(span(0, 3, "two")))
    codes = rows.row_codes(kind, F.when(i % 7 == 0, 0).otherwise(1), F.when(i % 5 != 0, "one answer"), labels)
    return labelled(spark, sf_dir).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""with c as (select unnest(flatten([case when doc_id % 4 = 0 then ['TAG_LEFT'] else [] end, case doc_id % 5 when 0 then ['NO_LABELS'] when 1 then ['NEGATIVE_OFFSET', 'NOT_AT_END'] when 2 then ['BEYOND_OUTPUT', 'NOT_AT_END', 'TOO_LONG'] when 3 then ['NOT_AT_END'] else [] end])) as code from documents) select code, count(*) as n from c group by code""")
def export_codes(spark, sf_dir):
    i = F.col("doc_id")
    label = lambda a, b, yes=False: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(yes).alias("implicit_true")))
    output = F.when(i % 4 == 0, "a <hall>b</hall>").otherwise("sixteen letters!")
    labels = F.when(i % 5 == 0, F.slice(label(0, 1), 1, 0)).when(i % 5 == 1, label(-2, 3)).when(i % 5 == 2, label(0, 2000)).when(i % 5 == 3, label(0, 4)).otherwise(label(0, 4, True))
    return _table(spark, sf_dir, "documents").select(F.explode(rows.export_codes(output, labels, suffix=True)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""with t as (select vec_id as id, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 as pos from embeddings), f as (select id, pos from t where v > 0.1), g as (select *, case when pos - lag(pos) over (partition by id order by pos) <= 2 then 0 else 1 end as new from f), r as (select *, sum(new) over (partition by id order by pos) run from g), e as (select id, min(pos) as start, max(pos) + 1 as "end" from r group by id, run)
select e.id, cast(e.start as int) as start, cast(e."end" as int) as "end", e."end" - e.start as n, avg(t.v) as mean_score from e join t on t.id = e.id and t.pos >= e.start and t.pos < e."end" where e."end" - e.start >= 3 group by all""")
def token_spans(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    tokens = e.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v")).withColumn("hit", F.col("v") > 0.1).withColumn("v", F.col("v").cast("double"))
    return spans.token_runs(tokens, "id", "pos", "hit", "v", holes=1, least=3)


@query("""with n as (select doc_id, cast(case when doc_id % 97 = 0 then 300 else doc_id % 20 end as int) as n from documents), c as (select doc_id, n, unnest(range(0, n)) as s from n), e as (select doc_id, n, s, unnest(range(s, least(s + 50, n))) as e from c), r as (select *, row_number() over (partition by doc_id order by s, e) - 1 as i, count(*) over (partition by doc_id) as total from e)
select doc_id, cast(s as int) as start, cast(e as int) as "end" from r where i % (case when total > 5000 then total // 5000 else 1 end) = 0""")
def candidate_spans(spark, sf_dir):
    return spans.candidate_spans(_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 97 == 0, 300).otherwise(F.col("doc_id") % 20).cast("int").alias("n")), "doc_id", "n")


@query("""with t as (select vec_id as id, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 as pos from embeddings), s as (select vec_id as id, cast(vec_id % 20 + k * 10 as int) as a, cast(vec_id % 20 + k * 10 + vec_id % 7 as int) as b from embeddings, range(3) r(k)), f as (select id, pos, 0 as feature, cast(v as double) as v from t union all select id, pos, 1, cast(v as double) * v from t)
select s.id, a as start, b as "end", feature, avg(v) as value from s join f on f.id = s.id and pos between a and b group by all""")
def span_features(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    v = F.col("v").cast("double")
    both = F.explode(F.array(F.struct(F.lit(0).alias("feature"), v.alias("value")), F.struct(F.lit(1).alias("feature"), (v * v).alias("value"))))
    tokens = e.select("id", F.posexplode("embedding").alias("place", "v")).select("id", "place", both.alias("f")).select("id", "place", "f.feature", "f.value")
    start = (F.col("id") % 20 + F.col("k") * 10).cast("int")
    chosen = e.select("id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).select("id", start.alias("start"), (start + F.col("id") % 7).cast("int").alias("end"))
    return spans.span_features(chosen, tokens, "id")


@query("""with w as (select item_id, text, string_split(text, ' ') as w from benchmark), c as (select *, list_transform(range(1, len(w) + 1), lambda i: {'a': length(array_to_string(list_slice(w, 1, i - 1), ' ')) + cast(i > 1 as int), 'n': length(w[i])}) as o, item_id % 4 as s, item_id % 4 + 2 + item_id % 3 as e from w)
select item_id, cast(o[s + 1].a as int) as start, cast(o[e + 1].a + o[e + 1].n as int) as "end", substr(text, o[s + 1].a + 1, o[e + 1].a + o[e + 1].n - o[s + 1].a) as text from c where e < len(w)""")
def character_spans(spark, sf_dir):
    d = _table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    before = lambda i: F.length(F.array_join(F.slice("w", F.lit(1), i), " ")) + (i > 0).cast("int")
    offsets = F.transform("w", lambda x, i: F.struct(before(i).alias("start"), (before(i) + F.length(x)).alias("end")))
    i = F.col("item_id")
    run = F.array(F.struct((i % 4).cast("int").alias("start"), (i % 4 + 2 + i % 3).cast("int").alias("end")))
    return d.select("item_id", F.explode(spans.character_spans(F.col("text"), offsets, run)).alias("s")).select("item_id", "s.start", "s.end", "s.text")


@query(r"""with s as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) as p from documents) select doc_id, cast(len(list_filter(p, lambda x: regexp_matches(x, '\S'))) as int) as n, cast(coalesce(list_sum(list_transform(list_filter(p, lambda x: regexp_matches(x, '\S')), lambda x: length(x))), 0) as bigint) as chars from s""")
def sentence_spans(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", text.sentence_spans(F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"]).alias("chars"))


@query(r"""select conv_id, turn, rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) as cleaned, turn % 3 <> 2 as changed from conversations where regexp_matches(coalesce(text, ''), '\S')""")
def followups_removed(spark, sf_dir):
    """Messages with one or two follow-up questions put behind them, in paragraphs of their own; every third has none."""
    tails = ("\n\nWould you like me to go on?", "\n\nIs there anything else you would like to know?\n \nCan I help with anything else?  ", "")
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t")).where(F.col("t").rlike(r"\S"))
    r = cleanup.without_followups(F.concat("t", _nth(tails, F.col("turn") % 3)))
    return d.select("conv_id", "turn", r["cleaned"].alias("cleaned"), r["changed"].alias("changed"))
