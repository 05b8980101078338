"""Queries of the dialogue operators over views derived from the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import json_tree, text
from spanloom.operators import dialogue, flows, metrics, reports, spans
from spanloom.plans import completion
from spanloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CLASSES = "['clean', 'answer_mismatch', 'overgeneration', 'missing_tool', 'undergeneration']"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Derived views: gold and predicted classes by arithmetic on ids, spans by arithmetic on ids and lengths.
LABELLED_SQL = f"""labelled as (select l.doc_id, d.text, d.n_chars, ({CLASSES})[cast((l.doc_id * 3 + 1) % 5 + 1 as int)] as gold,
  ({CLASSES})[cast((l.doc_id * 7 + l.doc_id // 4) % 5 + 1 as int)] as pred, (l.doc_id * 5 + l.doc_id // 3) % 4 <> 0 as flagged from labels l join documents d using (doc_id))"""
SPANS_SQL = """pairs as (select doc_id, n_chars,
  list_transform(range(0, cast(doc_id % 4 as bigint)), lambda i: {'start': (doc_id * 7 + i * 13) % greatest(n_chars - 20, 1), 'end': (doc_id * 7 + i * 13) % greatest(n_chars - 20, 1) + 5 + (doc_id + i) % 11}) as gold,
  list_transform(range(0, cast((doc_id + 1) % 4 as bigint)), lambda i: {'start': (doc_id * 7 + i * 13 + doc_id % 3) % greatest(n_chars - 20, 1), 'end': (doc_id * 7 + i * 13 + doc_id % 3) % greatest(n_chars - 20, 1) + 5 + (doc_id + i) % 11}) as pred from documents)"""
DIALOGUES_SQL = "dialogues as (select conv_id, list({'role': lower(trim(role)), 'content': coalesce(text, '')} order by turn) as messages from conversations group by conv_id)"
SHARES_SQL = """coalesce(tp / nullif(tp + fp, 0), 0.0) as "precision", coalesce(tp / nullif(tp + fn, 0), 0.0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) as f1"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda e: F.element_at(F.array(*[F.lit(c) for c in metrics.CLASSES]), (e % 5 + 1).cast("int"))
    d, i = _table(spark, sf_dir, "labels").select("doc_id").join(_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id"), F.col("doc_id")
    return d.withColumns({"gold": pick(i * 3 + 1), "pred": pick(i * 7 + F.floor(i / 4)), "flagged": (i * 5 + F.floor(i / 3)) % 4 != 0})


def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = _table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("doc_id")

    def made(n: Column, shift: Column | int) -> Column:
        start = lambda k: (i * 7 + k * 13 + shift) % F.greatest(F.col("n_chars") - 20, F.lit(1))
        one = lambda k: F.struct(start(k).alias("start"), (start(k) + 5 + (i + k) % 11).alias("end"))
        return F.transform(F.slice(F.array(*[F.lit(k).cast("bigint") for k in range(3)]), F.lit(1), n.cast("int")), one)

    return d.withColumns({"gold": made(i % 4, 0), "pred": made((i + 1) % 4, i % 3)})


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.gather(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def orders_with_items(spark: SparkSession, sf_dir: str, orders: list[Column], partitions: int | None = None) -> DataFrame:
    """o_orderkey, items and the given columns of orders.

    Both sides grow alike, so neither is broadcast, however few bytes its files hold: the driver would have to build the whole table.
    With partitions, rows are dealt over that many, in the one shuffle that the items need.
    """
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("l_quantity")).alias("item"))
    lines = lines if partitions is None else lines.repartition(partitions, "o_orderkey")
    items = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", *orders).join(items.hint("merge"), "o_orderkey")


def dealt(spark: SparkSession) -> int:
    """Over how many partitions rows go that are small but take long to work on: all cores have some, which adaptive execution wouldn't see to for so few bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items as JSON text."""
    body = F.to_json(F.struct("o_orderkey", "o_orderstatus", "items"))
    return orders_with_items(spark, sf_dir, [F.col("o_orderstatus")], dealt(spark)).select("o_orderkey", "o_orderstatus", body.alias("json"))


@query(f"""with {LABELLED_SQL}, c as (select gold, count(*) filter (where flagged) as yes, count(*) filter (where not flagged) as no from labelled group by gold),
v as (select (select yes from c where gold = 'clean') cy, (select no from c where gold = 'clean') cn, (select cast(sum(no) as bigint) from c where gold in ('answer_mismatch', 'overgeneration', 'missing_tool')) missed),
r as (select gold as class, case when gold = 'clean' then no else yes end as tp, case when gold = 'clean' then missed else cy end as fp, case when gold = 'clean' then yes else no end as fn, yes + no as support from c, v where gold <> 'undergeneration')
select *, {SHARES_SQL} from r""")
def class_detection_report(spark, sf_dir):
    return metrics.detection_report(labelled(spark, sf_dir)).where(~F.col("class").isin("undergeneration", "ALL")).drop("flag_rate")


@query(f"with {LABELLED_SQL}, b as (select gold <> 'clean' as g, pred <> 'clean' as p from labelled), r as (select count(*) filter (where g and p) tp, count(*) filter (where p and not g) fp, count(*) filter (where g and not p) fn, count(*) filter (where not g and not p) tn, count(*) n from b) select *, (tp + tn) / n as accuracy, {SHARES_SQL} from r")
def binary_report(spark, sf_dir):
    return metrics.binary_report(labelled(spark, sf_dir).select((F.col("gold") != "clean").alias("g"), (F.col("pred") != "clean").alias("p")), "g", "p")


REPORT_SQL = f"""{LABELLED_SQL}, r as (select label, count(*) filter (where gold = label and pred = label) tp, count(*) filter (where gold <> label and pred = label) fp, count(*) filter (where gold = label and pred <> label) fn, count(*) filter (where gold = label) support from labelled, (select unnest({CLASSES}) as label) group by label), rep as (select *, {SHARES_SQL} from r where tp + fp + fn > 0)"""


@query(f"with {REPORT_SQL} select * from rep")
def classification_report(spark, sf_dir):
    return metrics.classification_report(labelled(spark, sf_dir), "gold", "pred")


@query(f"with {REPORT_SQL} select avg(\"precision\") macro_precision, avg(recall) macro_recall, avg(f1) macro_f1, sum(f1 * support) / sum(support) weighted_f1, sum(tp) / sum(support) accuracy from rep where support > 0")
def macro_averages(spark, sf_dir):
    return metrics.macro(metrics.classification_report(labelled(spark, sf_dir), "gold", "pred"))


@query(f"with {LABELLED_SQL}, k as (select unnest({CLASSES} || ['other']) as c) select a.c as gold, b.c as pred, count(l.doc_id) as n from k a, k b left join labelled l on l.gold = a.c and l.pred = b.c group by all")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir), "gold", "pred")


@query(f"""with {LABELLED_SQL}, c as (select count(*) filter (where gold = 'clean') c0, count(*) filter (where gold = 'answer_mismatch') c1, count(*) filter (where gold = 'overgeneration') c2, count(*) filter (where gold = 'missing_tool') c3 from labelled),
g as (select k / 1000 as q, (coalesce(2 * (1 - q) * c0 / nullif((1 - q) * c0 + (1 - q) * (c0 + c1 + c2 + c3) + q * c0, 0), 0) + coalesce(2 * q * c1 / nullif(2 * q * c1 + q * c0 + (1 - q) * c1, 0), 0) + coalesce(2 * q * c2 / nullif(2 * q * c2 + q * c0 + (1 - q) * c2, 0), 0) + coalesce(2 * q * c3 / nullif(2 * q * c3 + q * c0 + (1 - q) * c3, 0), 0)) / 4 as m from c, range(1001) t(k)) select max(m) as mean_f1, arg_max(q, m) as flag_rate from g""")
def chance_level(spark, sf_dir):
    return metrics.chance_level(labelled(spark, sf_dir))


@query("with r as (select n_chars v, row_number() over (order by n_chars) - 1 as i, count(*) over () n from documents where n_chars is not null) select any_value(n) as n, max(v) as greatest, avg(v) as mean, min(case when i = floor(n * 0.95) then v end) as p95 from r")
def length_statistics(spark, sf_dir):
    return metrics.length_statistics(_table(spark, sf_dir, "documents"), "n_chars")


PAIR_SCORES = f"{SPANS_SQL}, x as (select doc_id, unnest(pred) p, gold from pairs), z as (select doc_id, p, unnest(gold) g from x)"


@query(f"with {PAIR_SCORES} select p.doc_id, len(p.pred) as n_pred, len(p.gold) as n_gold, coalesce(bool_or(least(z.p.\"end\", z.g.\"end\") > greatest(z.p.start, z.g.start)), false) as any_overlap, coalesce(max(greatest(least(z.p.\"end\", z.g.\"end\") - greatest(z.p.start, z.g.start), 0) / ((z.p.\"end\" - z.p.start) + (z.g.\"end\" - z.g.start) - greatest(least(z.p.\"end\", z.g.\"end\") - greatest(z.p.start, z.g.start), 0))), 0.0) as best_iou from pairs p left join z using (doc_id) group by all")
def span_overlaps(spark, sf_dir):
    d = span_pairs(spark, sf_dir)
    best = F.array_max(F.flatten(F.transform("pred", lambda p: F.transform("gold", lambda g: spans.iou(p, g)))))
    return d.select("doc_id", F.size("pred").alias("n_pred"), F.size("gold").alias("n_gold"), spans.any_overlap(F.col("pred"), F.col("gold")).alias("any_overlap"), F.coalesce(best, F.lit(0.0)).alias("best_iou"))


@query(f"""with {SPANS_SQL}, p as (select doc_id, list_distinct(flatten(list_transform(pred, lambda s: range(s.start, s."end")))) c, list_distinct(flatten(list_transform(gold, lambda s: range(s.start, s."end")))) g from pairs)
select doc_id, len(c) as pred_chars, len(g) as gold_chars, len(list_intersect(c, g)) as common_chars, case when len(c) + len(g) = 0 then 1.0 else 2 * len(list_intersect(c, g)) / (len(c) + len(g)) end as char_f1 from p""")
def span_char_f1(spark, sf_dir):
    d = span_pairs(spark, sf_dir).select("doc_id", "pred", "gold", spans.merge(F.col("pred")).alias("p"), spans.merge(F.col("gold")).alias("g"))
    p, g = F.col("p"), F.col("g")
    return d.select("doc_id", spans.covered_length(p).alias("pred_chars"), spans.covered_length(g).alias("gold_chars"), spans.common_length(p, g).alias("common_chars"), spans.char_f1(F.col("pred"), F.col("gold")).alias("char_f1"))


def _greedy_sql(score: str, keep: str, order: str) -> str:
    """Matches of a one-to-one assignment: pairs in an order, taken if both sides are free; at most 3 by 3, so 9 steps."""
    pairs = f"""list_sort(list_filter(flatten(list_transform(range(0, len(pred)), lambda i: list_transform(range(0, len(gold)), lambda j: {{'v': {score}, 'i': i, 'j': j}}))), lambda x: {keep}), '{order}')"""
    return f"list_reduce(list_transform({pairs}, lambda x: x.i * 10 + x.j), lambda a, x: case when len(list_filter(a, lambda k: k // 10 = x // 10 or k % 10 = x % 10)) = 0 then list_append(a, x) else a end, cast([] as bigint[]))"


_P, _G = "pred[i + 1]", "gold[j + 1]"
_BOTH = f'greatest(least({_P}."end", {_G}."end") - greatest({_P}.start, {_G}.start), 0)'
_UNION = f'(({_P}."end" - {_P}.start) + ({_G}."end" - {_G}.start) - {_BOTH})'
_HULL = f'(greatest({_P}."end", {_G}."end") - least({_P}.start, {_G}.start))'


@query(f"""with {SPANS_SQL} select doc_id, cast(coalesce(len({_greedy_sql(f"{_BOTH} / {_UNION}", "x.v > 0.75", "DESC")}), 0) as int) as by_iou, cast(coalesce(len({_greedy_sql(f"case when {_BOTH} > 0 then -1 else 0 end", "x.v < 0", "ASC")}), 0) as int) as by_overlap,
cast(coalesce(len({_greedy_sql(f"case when {_BOTH} / {_HULL} >= 0.5 then -1 else 0 end", "x.v < 0", "ASC")}), 0) as int) as by_hull, list_sort(list_distinct(list_transform(pred, lambda s: [s.start, s."end"]))) = list_sort(list_distinct(list_transform(gold, lambda s: [s.start, s."end"]))) as exact from pairs""")
def span_matches(spark, sf_dir):
    p, g = F.col("pred"), F.col("gold")
    return span_pairs(spark, sf_dir).select("doc_id", spans.match_iou(p, g).alias("by_iou"), spans.match_overlap(p, g).alias("by_overlap"), spans.match_hull(p, g).alias("by_hull"), spans.exact(p, g).alias("exact"))


_WORDS_SQL = r"""list_filter(list_distinct(flatten(list_transform({0}, lambda s: regexp_split_to_array(lower(substr(text, s.start + 1, s."end" - s.start)), '\s+')))), lambda x: x <> '')"""
_F1_SQL = "case when len({0}) + len({1}) = 0 then 1.0 else 2 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) end"


@query(f"""with {LABELLED_SQL}, {SPANS_SQL}, m as (select doc_id, coalesce(len({_greedy_sql(f"{_BOTH} / {_UNION}", "x.v > 0.75", "DESC")}), 0) as matched, len(pred) as n_pred, len(gold) as n_gold, list_distinct(flatten(list_transform(pred, lambda s: range(s.start, s."end")))) as pc, list_distinct(flatten(list_transform(gold, lambda s: range(s.start, s."end")))) as gc, {_WORDS_SQL.format("pred")} as pw, {_WORDS_SQL.format("gold")} as gw,
list_sort(list_distinct(list_transform(pred, lambda s: [s.start, s."end"]))) = list_sort(list_distinct(list_transform(gold, lambda s: [s.start, s."end"]))) as exact from pairs join (select doc_id, text from documents) using (doc_id)),
r as (select coalesce(l.gold, 'ALL') as gold, sum(matched) tp, sum(n_pred) - sum(matched) fp, sum(n_gold) - sum(matched) fn, avg({_F1_SQL.format("pc", "gc")}) as mean_char_f1, avg({_F1_SQL.format("pw", "gw")}) as mean_token_f1, avg(cast(exact as double)) as exact_rate, count(*) as n from m join (select doc_id, gold from labelled) l using (doc_id) group by rollup (l.gold))
select gold, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, mean_char_f1, mean_token_f1, exact_rate, n, {SHARES_SQL} from r""")
def span_metrics_by_class(spark, sf_dir):
    p, g = F.col("pred"), F.col("gold")
    docs = labelled(spark, sf_dir).select("doc_id", "text", F.col("gold").alias("class"))
    per = span_pairs(spark, sf_dir).join(docs, "doc_id").select("class", F.size(p).alias("n_pred"), F.size(g).alias("n_gold"), spans.match_iou(p, g).alias("matched"), F.lit(0).alias("unlocatable"), spans.char_f1(p, g).alias("char_f1"), spans.token_f1(F.col("text"), p, g).alias("token_f1"), spans.exact(p, g).alias("exact"))
    return metrics.span_report(per.withColumnRenamed("class", "gold"))


@query("""with t as (select doc_id, text, length(text) as n from documents where length(text) >= 8), p as (select *, substr(text, cast(doc_id * 13 % (n - 5) + 1 as bigint), 4) as part, doc_id * 31 % n as anchor from t),
f as (select *, list_filter(range(0, n - 3), lambda i: substr(text, i + 1, 4) = part) as ps from p) select doc_id, cast(len(ps) as int) as times, cast(list_sort(list_transform(ps, lambda i: {'d': abs(i - anchor), 'i': i}))[1].i as int) as at from f""")
def span_anchoring(spark, sf_dir):
    """Four characters from inside each whole document, anchored somewhere else in it."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") >= 8)
    i, n = F.col("doc_id"), F.length("text")
    d = d.withColumn("part", F.substring("text", (i * 13 % (n - 5) + 1).cast("int"), F.lit(4))).withColumn("anchor", (i * 31 % n).cast("int"))
    return d.select("doc_id", F.size(spans.occurrences(F.col("text"), F.col("part"))).alias("times"), spans.nearest_occurrence(F.col("text"), F.col("part"), F.col("anchor")).alias("at"))


@query("""with t as (select id, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 as pos from (select vec_id as id, embedding from embeddings)), f as (select id, pos, v from t where v > 0.1),
g as (select *, case when pos - lag(pos) over (partition by id order by pos) <= 1 then 0 else 1 end as new from f), r as (select *, sum(new) over (partition by id order by pos) run from g)
select id, min(pos) as start, max(pos) + 1 as "end", count(*) as n from r group by id, run having count(*) >= 2""")
def token_runs(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    tokens = e.select(F.col(e.columns[0]).alias("id"), F.posexplode("embedding").alias("pos", "v")).withColumn("hit", F.col("v") > 0.1)
    return spans.token_runs(tokens, "id", "pos", "hit", "v", holes=0, least=2).drop("mean_score")


@query("""with t as (select vec_id as id, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 as pos from embeddings), w as (select id, pos, case when count(*) over a = 8 then cast(avg(cast(v as double)) over a >= 0 as int) end as hit from t window a as (partition by id order by pos rows between current row and 7 following)),
s as (select id, pos, coalesce(avg(hit) over (partition by id order by pos rows between 7 preceding and current row), 1.0) as share from w) select id, cast(pos as int) as pos, share, share >= 0.5 as flagged from s""")
def window_votes(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    tokens = e.select(F.col(e.columns[0]).alias("id"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return spans.window_votes(tokens, "id", "pos", "v", 8, 0.0).drop("v")


@query(f"with {DIALOGUES_SQL}, l as (select conv_id, messages, list_max(list_filter(list_transform(range(0, len(messages)), lambda i: case when messages[i + 1].role = 'assistant' then i end), lambda i: i is not null)) a from dialogues), u as (select *, list_max(list_filter(list_transform(range(0, a), lambda i: case when messages[i + 1].role = 'user' then i end), lambda i: i is not null)) q from l where a is not null) select conv_id, coalesce(messages[q + 1].content, '') as query, messages[a + 1].content as output, a - q as distance from u")
def target_turns(spark, sf_dir):
    m = F.col("messages")
    a = dialogue.last_index(m, lambda x: x["role"] == "assistant")
    u = dialogue.last_index(F.slice(m, F.lit(1), a), lambda x: x["role"] == "user")
    d = dialogues(spark, sf_dir).select("conv_id", dialogue.target_turn(m).alias("t"), (a - u).alias("distance")).where("t is not null")
    return d.select("conv_id", "t.query", "t.output", "distance")


@query(f"with {DIALOGUES_SQL}, u as (select conv_id, messages, list_filter(list_transform(range(0, len(messages)), lambda i: case when messages[i + 1].role = 'user' then i end), lambda i: i is not null) us from dialogues), t as (select conv_id, case when len(us) > 1 then list_slice(messages, us[-1] + 1, len(messages)) else messages end m from u) select conv_id, len(m) as n, list_aggregate(list_transform(m, lambda x: x.role || ': ' || x.content), 'string_agg', chr(10)) as transcript from t")
def trimmed_histories(spark, sf_dir):
    t = dialogue.trim_history(F.col("messages"), 1)
    return dialogues(spark, sf_dir).select("conv_id", F.size(t).alias("n"), dialogue.render(t).alias("transcript"))


@query(f"with {DIALOGUES_SQL}, u as (select conv_id, messages, list_filter(list_transform(range(0, len(messages)), lambda i: case when messages[i + 1].role = 'user' then i end), lambda i: i is not null) us from dialogues), t as (select conv_id, case when len(us) > 1 then list_slice(messages, us[-1] + 1, len(messages)) else messages end m from u) select conv_id, len(m) as n, list_aggregate(list_transform(m, lambda x: x.role || ': ' || x.content), 'string_agg', chr(10)) as transcript from t")
def whole_histories(spark, sf_dir):
    t = dialogue.trim_history(F.col("messages"), 1)
    return dialogues(spark, sf_dir).select("conv_id", F.size(t).alias("n"), dialogue.render(t).alias("transcript"))


@query(f"with {DIALOGUES_SQL}, m as (select len(messages) n, list_sum(list_transform(messages, lambda x: length(x.content))) c, len(list_filter(messages, lambda x: x.role = 'user')) u from dialogues) select count(*) dialogues, cast(sum(n) as bigint) messages, cast(sum(c) as bigint) chars, avg(n) mean_messages, count(*) filter (where u > 1) several_turns from m")
def processing_report(spark, sf_dir):
    return dialogue.processing_report(dialogues(spark, sf_dir))


CALL_SQL = r"regexp_full_match(trim(text), '(?s)\[.*[A-Za-z0-9_./ -]+\([^\]\[]*\).*\]')"


@query(f"""with c as (select conv_id, turn, case when role = 'assistant' and turn % 4 = 1 then 'tool_call' when role = 'user' and turn % 4 = 2 then 'tool' else lower(trim(role)) end as role, coalesce(text, '') as text from conversations),
f as (select *, sum(cast(role = 'user' as int)) over (partition by conv_id order by turn) as segment, role = 'tool_call' or (role = 'assistant' and {CALL_SQL}) as call, role = 'tool' as result, role = 'assistant' and not {CALL_SQL} as answer from c),
a as (select *, min(turn) filter (where call) over s as first_call from f where segment > 0 window s as (partition by conv_id, segment)), b as (select *, max(turn) filter (where result and turn > first_call) over s as last_result from a window s as (partition by conv_id, segment)),
t as (select conv_id, segment, min(turn) as user_index, count(*) filter (where call) as n_calls, count(*) filter (where result and turn > first_call) as n_results, min(turn) filter (where answer and turn > last_result) as answer_index from b group by all)
select conv_id, user_index, n_calls, n_results, answer_index, cast(row_number() over (partition by conv_id order by segment) as int) as turn_number from t where answer_index is not null and n_calls > 0 and n_results > 0""")
def completed_tool_turns(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "tool_call").when((F.col("role") == "user") & (F.col("turn") % 4 == 2), "tool").otherwise(F.col("role"))
    return dialogue.completed_turns(c.withColumn("role", role), "conv_id", "turn", "role", "text")


VERDICT = "case doc_id % 4 when 0 then 'pass' when 1 then 'fail' when 2 then 'uncertain' end"


@query(f"select l.doc_id, coalesce(v, 'missing') as outcome, coalesce(v, 'missing') in ('pass', 'uncertain') as keep from labels l left join (select doc_id, {VERDICT} v from labels where doc_id % 4 <> 3) using (doc_id)")
def verdict_filter(spark, sf_dir):
    rows, i = _table(spark, sf_dir, "labels").select("doc_id"), F.col("doc_id")
    lines = rows.where("doc_id % 4 <> 3").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("line"))
    real = F.when(i % 4 == 0, "pass").when(i % 4 == 1, "fail").otherwise("uncertain")
    verdicts = lines.withColumn("verdict", F.when(F.col("line") == 1, real).otherwise("fail"))  # the last line counts
    return flows.filter_by_verdict(rows, verdicts, ["doc_id"], "line", keep_uncertain=True)


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def not_done(spark, sf_dir):
    return flows.not_done(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), ["doc_id"])


@query("with k as (select distinct source from documents), r as (select source, row_number() over (order by source) r, count(*) over () n from k) select doc_id, case when r <= greatest(1, cast(floor(n * 0.1) as int)) then 'test' when r <= 2 * greatest(1, cast(floor(n * 0.1) as int)) then 'dev' else 'train' end as split from documents join r using (source)")
def group_split(spark, sf_dir):
    return flows.group_split(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.col("source")).select("doc_id", "split")


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id * 7919 % 1009, doc_id) r from documents) where r <= 5")
def sample_per_class(spark, sf_dir):
    return flows.sample_per_class(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 5, F.struct((F.col("doc_id") * 7919 % 1009).alias("a"), "doc_id"))


@query("select code, count(*) as n from (select unnest([case when trim(text) = '' then 'EMPTY' end, case when length(text) > 5000 then 'LONG' end, case when source is null then 'NO_SOURCE' end, 'SEEN']) code from documents) where code is not null group by code")
def issue_counts(spark, sf_dir):
    codes = F.array_compact(F.array(F.when(F.trim("text") == "", "EMPTY"), F.when(F.length("text") > 5000, "LONG"), F.when(F.col("source").isNull(), "NO_SOURCE"), F.lit("SEEN")))
    return flows.issue_counts(_table(spark, sf_dir, "documents").select(codes.alias("codes")), "codes")


@query("with o as (select o_orderkey from orders join (select distinct l_orderkey from lineitem) on o_orderkey = l_orderkey), i as (select l_orderkey k, l_linenumber, l_partkey, cast(l_quantity as bigint) q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1 as p from lineitem) select o_orderkey, path, value from (select o_orderkey, 'o_orderkey' as path, cast(o_orderkey as varchar) as value from o union all select o.o_orderkey, 'o_orderstatus', s.o_orderstatus from o join orders s using (o_orderkey) union all select k, 'items.' || p || '.l_linenumber', cast(l_linenumber as varchar) from i join o on k = o_orderkey union all select k, 'items.' || p || '.l_partkey', cast(l_partkey as varchar) from i join o on k = o_orderkey union all select k, 'items.' || p || '.l_quantity', cast(q as varchar) from i join o on k = o_orderkey)")
def json_leaves(spark, sf_dir):
    return json_tree.leaves(orders_json(spark, sf_dir), "o_orderkey", "json", "path", "value")


@query("select o_orderkey, 'o_orderstatus' as path, o_orderstatus as before, case when o_orderkey % 2 = 0 then null else 'X' end as after, case when o_orderkey % 2 = 0 then 'deleted' else 'changed' end as change from orders where o_orderkey in (select l_orderkey from lineitem)")
def json_edits(spark, sf_dir):
    odd = F.col("o_orderkey") % 2 == 1
    d = orders_json(spark, sf_dir).withColumns({"gone": F.when(~odd, F.array(F.lit("o_orderstatus"))), "old": F.when(odd, F.col("o_orderstatus")), "new": F.lit("X")})
    return json_tree.edited(d, "o_orderkey", "json", "gone", "old", "new", "changes").select("o_orderkey", F.inline("changes"))


@query("""with i as (select l_orderkey k, l_linenumber n, l_partkey a, cast(l_quantity as bigint) q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as p from lineitem), g as (select k, count(*) as c, string_agg('{"l_linenumber":' || n || ',"l_partkey":' || a || ',"l_quantity":' || q || '}', ',' order by p) as items, string_agg('  l_linenumber: ' || n || chr(10) || '  l_partkey: ' || a || chr(10) || '  l_quantity: ' || q, chr(10) order by p) as lines,
string_agg('{"type": "object", "properties": {"l_linenumber": {"type": "integer", "enum": [' || n || ']}, "l_partkey": {"type": "integer", "enum": [' || a || ']}, "l_quantity": {"type": "integer", "enum": [' || q || ']}}, "required": ["l_linenumber", "l_partkey", "l_quantity"], "additionalProperties": false}', ', ' order by p) as parts from i group by k), j as (select *, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","items":[' || items || ']}' as json from orders join g on o_orderkey = k)
select o_orderkey, 'o_orderkey: ' || o_orderkey || chr(10) || 'o_orderstatus: ' || o_orderstatus || chr(10) || 'items:' || chr(10) || lines as lines, '{"type": "object", "properties": {"o_orderkey": {"type": "integer", "enum": [' || o_orderkey || ']}, "o_orderstatus": {"type": "string", "enum": ["' || o_orderstatus || '"]}, "items": {"type": "array", "prefixItems": [' || parts || '], "minItems": ' || c || ', "maxItems": ' || c || '}}, "required": ["o_orderkey", "o_orderstatus", "items"], "additionalProperties": false}' as schema, json as recovered, json as first from j""")
def json_text_forms(spark, sf_dir):
    d = orders_json(spark, sf_dir)
    return d.select("o_orderkey", json_tree.flatten_json("json").alias("lines"), json_tree.lock("json").alias("schema"), json_tree.recover_json(F.expr("substring(json, 1, length(json) - 1)")).alias("recovered"), json_tree.first_json(F.concat(F.lit("Answer: "), "json", F.lit(" done"))).alias("first"))


@query(r"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) as n_sentences from documents")
def sentences(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query("""with n as (select l_orderkey k, l_linenumber i, cast(floor(l_extendedprice) as bigint) as p, (l_orderkey + l_linenumber) % 10 as f from lineitem)
select k, i, case f when 0 then cast(p as varchar) when 1 then p || '.5' when 2 then p || '000' when 3 then 'null' when 4 then 'true' when 5 then 'a b ' || p when 6 then chr(34) || p when 7 then '0.000' || (p % 9 + 1) when 8 then '-' || p else (p % 9 + 1) || 'e-07' end as canonical from n""")
def canonical_values(spark, sf_dir):
    """Ten ways to write a scalar: in quotes with commas, needless zeros, exponents, none, true, spaced words, a single quote, small and negative numbers."""
    price = F.col("l_extendedprice").cast("bigint")
    p, digit = price.cast("string"), (price % 9 + 1).cast("string")
    forms = [F.concat(F.lit("'"), F.format_number(price, 0), F.lit(" '")), F.concat(p, F.lit(".50")), F.concat(p, F.lit("e3")), F.lit(" None"), F.lit('"TRUE"'), F.concat(F.lit("a  b \n"), p), F.concat(F.lit('"'), p), F.concat(F.lit("0.000"), digit), F.concat(F.lit("-"), p, F.lit(".0")), F.concat(F.lit(".000000"), digit)]
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), text.canonical(F.get(F.array(*forms), ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).cast("int"))).alias("canonical"))


@query("select doc_id, coalesce(text, '') as text, 0 as start, cast(least(5, length(coalesce(text, ''))) as int) as \"end\" from documents")
def tag_round_trip(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    tagged = F.concat(F.lit("<OVER>"), F.substring("t", 1, 5), F.lit("</OVER>"), F.expr("substring(t, 6)"))
    return d.select("doc_id", text.tag_spans(tagged, "OVER").alias("r")).select("doc_id", "r.text", F.col("r.spans")[0]["start"].alias("start"), F.col("r.spans")[0]["end"].alias("end"))


@query("with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) + 1 as m from documents), p as (select doc_id, text, list_sort([doc_id * 7 % m, doc_id * 31 % m, doc_id * 101 % m, doc_id * 211 % m, doc_id * 503 % m, doc_id * 997 % m]) as p from d) select doc_id, text, cast(p[1] as int) as start_1, cast(p[2] as int) as end_1, cast(p[3] as int) as start_2, cast(p[4] as int) as end_2, cast(p[5] as int) as start_3, cast(p[6] as int) as end_3 from p")
def tag_round_trip_whole(spark, sf_dir):
    """Three tags, empty ones too, at places of the whole text that depend on doc_id; an empty or null text has them all at 0."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    cuts = F.array_sort(F.array(*[F.col("doc_id") * k % (F.length("t") + 1) for k in (7, 31, 101, 211, 503, 997)]))
    d = d.withColumn("p", cuts.cast("array<int>"))
    at = lambda i: F.col("p")[i]
    pieces = [F.substring("t", F.lit(1), at(0))]
    for i in range(6):
        end = at(i + 1) if i < 5 else F.length("t")
        pieces += [F.lit("<OVER>" if i % 2 == 0 else "</OVER>"), F.substring("t", at(i) + 1, end - at(i))]
    d = d.select("doc_id", text.tag_spans(F.concat(*pieces), "OVER").alias("r"))
    return d.select("doc_id", "r.text", *[F.col("r.spans")[k][x].alias(f"{x}_{k + 1}") for k in range(3) for x in ("start", "end")])


@query("select case d when 0 then 'all' when 1 then 'some' else 'none' end as kind, count(*) as n from (select doc_id % 3 as d from labels) group by d")
def union_and_count(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").select("doc_id")
    parts = [rows.where(F.col("doc_id") % 3 == k).withColumn("kind", F.lit(name)) for k, name in enumerate(("all", "some", "none"))]
    return flows.union_all(*parts).groupBy("kind").agg(F.count("*").alias("n"))


@query("select avg(s) mean_score, min(s) least, max(s) greatest, count(*) filter (where s = 1) all_supported, count(*) filter (where s < 0.5) below_half, cast(sum(a) as bigint) supported, cast(sum(b) as bigint) unsupported, cast(sum(c) as bigint) contradicted from (select doc_id % 5 as a, doc_id % 3 as b, doc_id % 2 as c, (doc_id % 5) / nullif(doc_id % 5 + doc_id % 3 + doc_id % 2, 0) as s from documents)")
def faithfulness(spark, sf_dir):
    i = F.col("doc_id")
    many = lambda label, n: F.array_repeat(F.lit(label), n.cast("int"))
    labels = F.concat(many("supported", i % 5), many("unsupported", i % 3), many("contradicted", i % 2))
    return metrics.faithfulness(_table(spark, sf_dir, "documents").select(labels.alias("labels")))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by all")
def windowed_counts(spark, sf_dir):
    return live.windowed_counts(_table(spark, sf_dir, "events"))


@query(f"""with {DIALOGUES_SQL}, l as (select conv_id, list_max(list_filter(range(0, len(messages)), lambda i: messages[i + 1].role = 'assistant')) a from dialogues) select conv_id, case when conv_id % 5 < 4 then 'ok' else 'error' end as status, case conv_id % 5 when 0 then 'clean' when 1 then 'overgeneration' when 3 then 'missing_tool' end as type, cast(case conv_id % 5 when 0 then 0 when 1 then 1 when 3 then 2 end as int) as n_spans from l where a is not null""")
def judged_answers(spark, sf_dir):
    """Stored responses, one of five missing and one without JSON, joined to the dialogues they judge and parsed."""
    turns = target_turns(spark, sf_dir).withColumn("prompt", completion.judge_prompt(F.col("query"), F.col("output")))
    said = ['Verdict: {"type": "clean", "span_labels": []}', '```json\n{"type": "overgeneration", "span_labels": [{"start": 1, "end": 3, "text": "x{"}]}\n``` as asked', "I can't say.", 'no {brace} {"type": "missing_tool", "span_labels": [{"start": 0, "end": 2, "text": "a"}, {"start": 4, "end": 5}]}']
    way = F.col("conv_id") % 5
    stored = turns.where(way < 4).select("conv_id", F.get(F.array(*[F.lit(x) for x in said]), way.cast("int")).alias("raw_response"))
    v = completion.parse_verdict("raw_response")
    return completion.refilled(turns.select("conv_id", "prompt"), stored, ["conv_id"]).select("conv_id", "status", v["type"].alias("type"), F.when(v["span_labels"].isNotNull(), F.size(v["span_labels"])).alias("n_spans"))


@query(f"""with {LABELLED_SQL}, g as (select case when doc_id % 3 = 0 then 'u' || doc_id end as uid, doc_id as r, 'd' || (doc_id % 500) as d, gold as t from labelled), p as (select uid, case when r % 2 = 0 then r else -1 end as r, d, t from g)
select p.d as dialogue_id, p.t as type, p.r as row_index, case when u.r is not null then 'uid' when i.r is not null then 'place' when one.r is not null then 'dialogue' when two.r is not null then 'type' end as how, coalesce(u.r, i.r, one.r, two.r) as gold_row from p
left join (select uid, min(r) r from g where uid is not null group by uid) u on p.uid = u.uid left join g i on i.r = p.r and i.d = p.d left join (select d, min(r) r from g group by d having count(*) = 1) one on one.d = p.d left join (select d, t, min(r) r from g group by d, t having count(*) = 1) two on two.d = p.d and two.t = p.t""")
def gold_look_up(spark, sf_dir):
    d = labelled(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), "doc_id")).alias("uid"), F.col("doc_id").alias("row_index"), F.concat(F.lit("d"), (F.col("doc_id") % 500).cast("string")).alias("dialogue_id"), F.col("gold").alias("type"))
    pred = d.withColumn("row_index", F.when(F.col("row_index") % 2 == 0, F.col("row_index")).otherwise(-1))
    return flows.look_up_gold(pred, d).select("dialogue_id", "type", "row_index", "how", "gold_row")


@query(f"""with {LABELLED_SQL}, p as (select gold, case when doc_id % 6 = 0 then null when doc_id % 5 = 0 then [pred, 'missing_tool'] else [pred] end preds from labelled), k as (select unnest({CLASSES}) as label),
r as (select label, count(*) filter (where gold = label and coalesce(list_contains(preds, label), false)) tp, count(*) filter (where gold <> label and coalesce(list_contains(preds, label), false)) fp, count(*) filter (where gold = label and not coalesce(list_contains(preds, label), false)) fn, count(*) filter (where gold = label) support from p, k group by label) select *, {SHARES_SQL} from r""")
def multi_label_report(spark, sf_dir):
    i = F.col("doc_id")
    preds = F.when(i % 6 == 0, None).when(i % 5 == 0, F.array("pred", F.lit("missing_tool"))).otherwise(F.array("pred"))
    return reports.class_metrics(labelled(spark, sf_dir).withColumn("preds", preds))


@query(f"""with {LABELLED_SQL}, r as (select case when flagged then gold else 'clean' end as by_detection, case when (not flagged and doc_id % 2 = 0) or (flagged and doc_id % 3 = 0) then gold else 'clean' end as by_overlap from labelled) select by_detection, by_overlap, count(*) as n from r group by all""")
def label_rules(spark, sf_dir):
    g, f = F.col("gold"), F.col("flagged")
    labels = labelled(spark, sf_dir).select(reports.detection_label(g, f).alias("by_detection"), reports.overlap_label(g, f.cast("int"), F.col("doc_id") % 2, f & (F.col("doc_id") % 3 == 0)).alias("by_overlap"))
    return labels.groupBy("by_detection", "by_overlap").agg(F.count("*").alias("n"))


@query(f"""with {LABELLED_SQL}, c as (select coalesce(gold, 'ALL') as gold, count(*) n, count(*) filter (where gold_bad and flagged) tp, count(*) filter (where not gold_bad and flagged) fp, count(*) filter (where gold_bad and not flagged) fn, count(*) filter (where not gold_bad and not flagged) tn, sum(doc_id % 2) m, sum(doc_id % 3) p, sum(doc_id % 2 + doc_id % 5) g from (select *, gold <> 'clean' as gold_bad from labelled) group by rollup (gold)),
f as (select gold, n, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) f1_positive, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0.0) f1_negative, coalesce(2 * m / nullif(p + g, 0), 0.0) span_f1, (tp + fp) / n flag_rate from c) select *, (f1_positive + f1_negative) / 2 as type_macro_f1, ((f1_positive + f1_negative) / 2 + span_f1) / 2 as score from f""")
def composite_scores(spark, sf_dir):
    i = F.col("doc_id")
    d = labelled(spark, sf_dir).withColumns({"bad": F.col("gold") != "clean", "matched": i % 2, "n_pred": i % 3, "n_gold": i % 2 + i % 5})
    return reports.composite_score(d, "bad", "flagged", "gold")


@query(f"with {LABELLED_SQL}, c as (select gold, pred, count(*) as n from labelled group by all), r as (select *, cast(row_number() over (partition by gold order by n desc, pred) as int) as place from c) select * from r where place <= 4")
def top_predictions(spark, sf_dir):
    return reports.top_predictions(labelled(spark, sf_dir), "gold", "pred")


@query(f"with {LABELLED_SQL} select gold as stored, case when doc_id % 4 = 0 then 'missing' else pred end as judged, count(*) as n, gold = (case when doc_id % 4 = 0 then 'missing' else pred end) as agree from labelled group by all")
def judge_summary(spark, sf_dir):
    return reports.judge_summary(labelled(spark, sf_dir).withColumn("judged", F.when(F.col("doc_id") % 4 != 0, F.col("pred"))), "gold", "judged")


@query("select doc_id, l.quality, d.n_chars, doc_id % 7 <> 0 as matched from labels l join documents d using (doc_id)")
def guarded_join(spark, sf_dir):
    left = _table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("doc_id").alias("guard"))
    right = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).otherwise(-1).alias("guard"))
    return reports.aligned(left, right, "doc_id", "guard").drop("guard")
