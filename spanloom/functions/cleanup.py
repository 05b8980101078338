"""Follow-up questions and offers at the end of an answer: finding them, and taking them off until none is left."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tail that holds one of these may be a follow-up.
CANDIDATES = (
    r"what would you like to do next\??",
    r"is there anything else you would like to know\??",
    r"is there anything else .*?(?:need|like)\??",
    r"if you need .*? please let me know!?",
    r"if you need .*? feel free to ask!?",
    r"let me know if you need .*",
    r"feel free to ask!?",
    r"would you like .*?\??",
    r"you may also check .*",
    r"i can also .*",
)
#: A whole fragment that is one of these is a follow-up.
WHOLE = (
    r"(?:what would you like to do next\??)",
    r"(?:is there anything else(?: you would like to know)?\??)",
    r"(?:would you like(?: me)? to .*?\??)",
    r"(?:do you want me to .*?\??)",
    r"(?:if you need .*?(?:please )?let me know!?)+",
    r"(?:if you need .*?feel free to ask!?)+",
    r"(?:let me know if you need .*?)+",
    r"(?:feel free to ask!?)+",
    r"(?:you may also check .*?)+",
    r"(?:i can also .*?)+",
    r"(?:if you'd like,? i can .*?)+",
    r"(?:if you want,? i can .*?)+",
    r"(?:please let me know if .*?)+",
    r"(?:can i help with anything else\??)",
)
FOLLOWUP = re.compile("|".join(WHOLE), re.I)
BREAK = re.compile(r"\n\s*\n")
SENTENCE_END = re.compile(r"[.!?](?=\s|$)")


def asks_back(c: Column, window: int = 400) -> Column:
    """Whether the last characters of an answer hold a question mark or a follow-up phrase. False for blank texts and null."""
    tail = F.lower(F.right(F.regexp_replace(c, r"\s+\z", ""), F.lit(window)))
    return F.coalesce(tail.contains("?") | tail.rlike("|".join(CANDIDATES)), F.lit(False))


def is_followup(part: str) -> bool:
    """Whether a paragraph or sentence is a follow-up and nothing else; marks of lists around it don't count."""
    plain = " ".join(part.strip().strip("-* \n\t").split()).lower()
    return bool(plain) and any(re.fullmatch(p, plain, re.I) for p in WHOLE)


def shortened(answer: str) -> str:
    """The answer without its trailing paragraphs and sentences that are follow-ups. Where paragraphs and sentences begin is found once; each round looks at the last of them only."""
    left = answer.rstrip()
    breaks = [m.span() for m in BREAK.finditer(left)]
    ends = [m.end() for m in SENTENCE_END.finditer(left)]
    while left:
        while breaks and breaks[-1][1] > len(left):
            breaks.pop()
        while ends and ends[-1] >= len(left):  # the last sentence starts behind the end before it
            ends.pop()
        start = ends[-1] if ends else 0
        if breaks and is_followup(left[breaks[-1][1] :]):
            left = left[: breaks[-1][0]].rstrip()
        elif is_followup(left[start:]):
            left = left[:start].rstrip()
        else:
            break
    return left


def without_followups(c: Column) -> Column:
    """struct(cleaned, changed): the text without follow-ups at its end, to a fixed point, and without white space there. Null gives nulls."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else shortened(t))

    cleaned = clean(c)
    return F.struct(cleaned.alias("cleaned"), (F.length(cleaned) < F.length(F.regexp_replace(c, r"\s+\z", ""))).alias("changed"))
