"""Dialogue structure: messages are arrays of struct(role, content) in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALL_ROLES = ("tool_call", "function_call")
RESULT_ROLES = ("tool", "tool_output", "function", "observation")
CALL_TEXT = r"^\s*\[[\s\S]*[A-Za-z0-9_./ -]+\([^\]\[]*\)[\s\S]*\]\s*$"


def gather(rows: DataFrame, key: str, place: str, role: str, content: str) -> DataFrame:
    """Long form -> one row for each dialogue, its messages ordered by place. One shuffle on the key."""
    message = F.struct(F.col(place).alias("pos"), F.lower(F.trim(F.coalesce(F.col(role), F.lit("")))).alias("role"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    ordered = F.array_sort(F.collect_list(message))
    return rows.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def is_call(m: Column) -> Column:
    return m["role"].isin(*CALL_ROLES) | ((m["role"] == "assistant") & m["content"].rlike(CALL_TEXT))


def is_result(m: Column) -> Column:
    return m["role"].isin(*RESULT_ROLES)


def is_answer(m: Column) -> Column:
    """A plain assistant message."""
    return (m["role"] == "assistant") & ~m["content"].rlike(CALL_TEXT)


def completed_turns(rows: DataFrame, key: str, place: str, role: str, content: str) -> DataFrame:
    """Per user segment with a call, a result after the first call and a plain answer after the last result: key, turn_number, user_index, n_calls, n_results, answer_index."""
    m = F.struct(F.lower(F.trim(F.col(role))).alias("role"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    w = W.partitionBy(key).orderBy(place)
    segment = F.sum((F.lower(F.trim(F.col(role))) == "user").cast("int")).over(w)
    d = rows.select(key, F.col(place).alias("pos"), m.alias("m"), segment.alias("segment")).where("segment > 0")
    s = W.partitionBy(key, "segment")
    d = d.withColumn("first_call", F.min(F.when(is_call(F.col("m")), F.col("pos"))).over(s))
    d = d.withColumn("result", is_result(F.col("m")) & (F.col("pos") > F.col("first_call")))
    d = d.withColumn("last_result", F.max(F.when(F.col("result"), F.col("pos"))).over(s))
    turns = d.groupBy(key, "segment").agg(
        F.min("pos").alias("user_index"),
        F.count_if(is_call(F.col("m"))).alias("n_calls"),
        F.count_if(F.coalesce("result", F.lit(False))).alias("n_results"),
        F.min(F.when(is_answer(F.col("m")) & (F.col("pos") > F.col("last_result")), F.col("pos"))).alias("answer_index"),
    )
    done = turns.where("answer_index is not null and n_calls > 0 and n_results > 0")
    return done.withColumn("turn_number", F.row_number().over(W.partitionBy(key).orderBy("segment"))).drop("segment")


def last_index(messages: Column, test) -> Column:
    """0-based place of the last message for which test holds, or null."""
    return F.array_max(F.transform(messages, lambda m, i: F.when(test(m), i)))


def target_turn(messages: Column) -> Column:
    """struct(query, contexts, output): the last assistant message, the user message before it (empty text if there is none), and the tool messages between. Null without an assistant message."""
    answer = last_index(messages, lambda m: m["role"] == "assistant")
    before = F.slice(messages, F.lit(1), answer)
    user = last_index(before, lambda m: m["role"] == "user")
    between = F.filter(F.slice(messages, F.coalesce(user, F.lit(-1)) + 2, answer - F.coalesce(user, F.lit(-1)) - 1), lambda m: m["role"] == "tool")
    query = F.coalesce(F.get(messages, user)["content"], F.lit(""))
    return F.when(answer.isNotNull(), F.struct(query.alias("query"), F.transform(between, lambda m: m["content"]).alias("contexts"), F.get(messages, answer)["content"].alias("output")))


def first_answer_fallback(messages: Column, last: bool = True) -> Column:
    """The final answer's text: of the last, or the first, assistant message."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.when(F.size(own) > 0, F.element_at(own, -1 if last else 1)["content"])


def trim_history(messages: Column, turns: int) -> Column:
    """The last turns led by a user; all of them if there are no more; none for 0."""
    if turns <= 0:
        return F.slice(messages, 1, 0)
    users = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    first = F.get(users, F.size(users) - turns)
    return F.when(F.size(users) > turns, F.slice(messages, first + 1, F.size(messages))).otherwise(messages)


def split_at_answer(messages: Column) -> Column:
    """struct(history, answer): up to the last assistant message; the whole and an empty text if there is none."""
    at = last_index(messages, lambda m: m["role"] == "assistant")
    return F.struct(F.when(at.isNull(), messages).otherwise(F.slice(messages, F.lit(1), at)).alias("history"), F.coalesce(F.get(messages, at)["content"], F.lit("")).alias("answer"))


def prune(messages: Column, last: Column) -> Column:
    """Up to and with the message at a 0-based place."""
    return F.slice(messages, F.lit(1), last + 1)


def render(messages: Column, most: int | None = None, separator: str = "\n") -> Column:
    """Transcript lines of role and content; whole contents, or each cut at `most` characters where that is given."""
    content = lambda m: m["content"] if most is None else F.substring(m["content"], F.lit(1), F.lit(most))
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), content(m))), separator)


def prompt_summary(messages: Column, most: int = 1200) -> Column:
    """Numbered lines of role and trimmed content for a prompt; a content over `most` characters is cut there and marked as truncated."""
    space = r"[\s\x1C-\x1F]+"

    def line(m: Column, i: Column) -> Column:
        content = F.regexp_replace(m["content"], rf"(?U)\A{space}|(?<![\s\x1C-\x1F]){space}\z", "")
        cut = F.regexp_replace(F.substring(content, F.lit(1), F.lit(most)), rf"(?U)(?<![\s\x1C-\x1F]){space}\z", "")
        shown = F.when(F.length(content) > most, F.concat(cut, F.lit("\n...[truncated]"))).otherwise(content)
        return F.concat((i + 1).cast("string"), F.lit(". "), m["role"], F.lit(": "), shown)

    return F.array_join(F.transform(messages, line), "\n")


def sft_messages(system: Column, query: Column, target: Column) -> Column:
    """The three messages of a supervised example."""
    make = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(make("system", system), make("user", query), make("assistant", target))


def processing_report(dialogues: DataFrame) -> DataFrame:
    """Counts and means of messages and characters over dialogues(messages)."""
    chars = F.aggregate("messages", F.lit(0), lambda acc, m: acc + F.length(m["content"]))
    users = F.size(F.filter("messages", lambda m: m["role"] == "user"))
    return dialogues.select(F.size("messages").alias("n"), chars.alias("chars"), users.alias("users")).agg(F.count("*").alias("dialogues"), F.sum("n").alias("messages"), F.sum("chars").alias("chars"), F.avg("n").alias("mean_messages"), F.count_if(F.col("users") > 1).alias("several_turns"))
