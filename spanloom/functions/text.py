"""Text scalars as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that is written in several ways, by its plain form.
PUNCTUATION = {
    "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212",
    "'": "\u2018\u2019\u201a\u201b\u2032",
    '"': "\u201c\u201d\u201e\u201f\u2033",
    " ": "\u00a0\u202f\u2007\u2009\u200a\u2002\u2003\u2005\u2008",
}
VARIANTS = "".join(PUNCTUATION.values())
PLAIN = "".join(k * len(v) for k, v in PUNCTUATION.items())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: inside lambdas an expression that is used twice is computed twice, and grows the plan as often."""
    return F.get(F.transform(F.array(value), use), 0)


def plain_punctuation(c: Column) -> Column:
    """Dashes, quotes and spaces in one form; offsets stay."""
    return F.translate(c, VARIANTS, PLAIN)


def sentences(c: Column) -> Column:
    """Trimmed sentences, cut at white space after . ! or ?"""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_spans(c: Column) -> Column:
    """struct(start, end) of sentences, which end with . ! or ? before white space or at the end; white space between belongs to the next one, blank ones are left out."""
    pieces = F.split(c, r"(?<=[.!?])(?=\s)", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        return F.struct(end.alias("at"), F.when(p.rlike(r"\S"), F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonical(c: Column) -> Column:
    """A scalar's text in one form: trimmed, without a pair of quotes around, true, false and null in lower case (none is null), numbers without thousands commas, needless zeros or an exponent of up to 16 digits; inner white space of other texts is one space."""
    def quoted(t: Column) -> Column:
        return F.when(t.rlike(r"""(?s)\A(?:".*"|'.*')\z""") & (F.length(t) >= 2), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)

    def numeric(t: Column) -> Column:
        bare = F.when(t.rlike(r"\A-?[0-9,]+(?:\.[0-9]+)?\z"), F.regexp_replace(t, ",", "")).otherwise(t)
        return F.when(t.rlike(r"\A[+-]?[0-9.,]"), bound(bare, lambda b: F.when(b.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), b.try_cast("double"))))

    def written(number: Column) -> Column:
        whole = F.when(F.abs(number) < 1e15, number.cast("bigint").cast("string")).otherwise(number.try_cast("decimal(38,0)").cast("string"))
        plain = F.regexp_replace(F.regexp_replace(number.try_cast("decimal(38,21)").cast("string"), r"0+\z", ""), r"\.\z", "")
        small = F.regexp_replace(F.regexp_replace(F.regexp_replace(number.cast("string"), r"\.0E", "E"), "E", "e"), r"e-([0-9])\z", "e-0$1")
        return F.when(number == F.floor(number), whole).when(F.abs(number) >= 1e-4, plain).otherwise(small)

    def other(t: Column) -> Column:
        low = F.lower(t)
        return F.when(low.isin("true", "false", "null"), low).when(low == "none", "null").otherwise(F.trim(F.regexp_replace(t, r"\s+", " ")))

    # A whole number of up to 15 digits without a leading zero is in its one form already.
    plain = r"\A(?:0|-?[1-9][0-9]{0,14})\z"
    one = lambda t: F.when(t.rlike(plain), t).otherwise(bound(numeric(t), lambda n: F.when(n.isNotNull() & (F.abs(n) < 1e37), written(n)).otherwise(other(t))))
    return bound(quoted(F.trim(c.cast("string"))), one)


def bounded_find(text: Column, part: str) -> Column:
    """0-based place of the part where no ASCII letter or digit touches it, or -1."""
    import re

    before = F.regexp_extract(text, rf"(?s)\A(.*?)(?<![A-Za-z0-9]){re.escape(part)}(?![A-Za-z0-9])", 1)
    return F.when(text.rlike(rf"(?<![A-Za-z0-9]){re.escape(part)}(?![A-Za-z0-9])"), F.length(before)).otherwise(-1)


def table_value(c: Column) -> Column:
    """Percent with two digits; a dash for null."""
    return F.when(c.isNotNull(), F.format_string("%.2f", 100 * c)).otherwise("—")


def tag_spans(c: Column, tag: str) -> Column:
    """struct(text, spans): the text without <tag>...</tag>, and where the tagged parts stand in it."""
    import re

    pattern = rf"(?s)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>"
    # What stands before each tag goes along with it: split inside the fold would be done again for every tag.
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("part"), F.split(c, pattern, -1).alias("before"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["before"])
        end = a + F.length(p["part"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(a.alias("start"), end.alias("end"), p["part"].alias("text"))).alias("spans"))

    tags = F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))
    return F.struct(F.regexp_replace(c, pattern, "$1").alias("text"), F.aggregate(tags, start, step, lambda acc: acc["spans"]).alias("spans"))


#: A sentence that holds one of these is filler.
FILLER = (
    r"(?i)feel free|let me know|if you need|anything else|further detail|"
    r"further assist|is there anything|happy to help|don'?t hesitate|"
    r"please let me|reach out|i(?:'?m| am) here|ask me|can i help|"
    r"any (other|more) (questions?|help|assist)"
)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def without_filler(c: Column) -> Column:
    """A text without the filler at its end: its last paragraph goes as long as it holds filler, else its last sentence, and the sentences left are joined by one space. Null stays null."""
    ends = r"""(?<=[.!?])\s+|(?<=[.!?]["'])\s+"""

    def shorter(t: Column) -> Column:
        last = F.substring_index(t, "\n\n", -1)
        paragraph = t.contains("\n\n") & last.rlike(FILLER)
        before = stripped(F.substring(t, F.lit(1), F.length(t) - F.length(last) - 2))
        sentence = bound(F.split(t, ends, -1), lambda s: F.when(F.element_at(s, -1).rlike(FILLER), stripped(F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), " "))))
        return F.when(paragraph, before).otherwise(sentence)

    # As many rounds as there may be paragraphs and sentences; once nothing goes, the rounds left cost nothing.
    rounds = F.sequence(F.lit(0), F.regexp_count(c, F.lit(r"[.!?]|\n\n")) + 1)
    start = F.struct(stripped(c).alias("t"), F.lit(False).alias("done"))
    step = lambda acc, _: F.when(acc["done"], acc).otherwise(bound(shorter(acc["t"]), lambda s: F.struct(F.coalesce(s, acc["t"]).alias("t"), s.isNull().alias("done"))))
    return F.when(c.isNotNull(), F.aggregate(rounds, start, step, lambda acc: acc["t"]))


def comment_is_fit(comment: Column, answer: Column) -> Column:
    """Whether a comment can be added to an answer: at least 15 characters, no filler, not already in the answer in any case, and at most three sentences. False for null."""
    new = ~F.lower(F.coalesce(answer, F.lit(""))).contains(F.lower(comment))
    return F.coalesce((F.length(comment) >= 15) & ~comment.rlike(FILLER) & new & (F.size(F.split(comment, r"(?<=[.!?])\s+", -1)) <= 3), F.lit(False))
