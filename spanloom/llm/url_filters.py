"""Operator 9: URL filters, by DataFrame functions only.

A URL is judged by the longest rule that fits its host or a parent domain and the start of its path. Where no rule fits, the method
decides: the URL is blocked if a list of canonical URLs holds its canonical form, or a form that covers it: one of its parent domains,
or its host or such a domain with one of the leading parts of its path. A blocked Bloom filter of the list, one mask of 64 bits for
each block, passes possible hits; a hash join with the list itself removes the false ones.

Canonical: host in lower case without user, port, `www.` and trailing dots; path without empty parts and `.`, without a trailing slash
or index page; without scheme, query and fragment. The filter has one block for about KEYS_A_BLOCK listed URLs, so that false hits
stay rare however long the list: it is a table of blocks, joined by broadcast up to BROADCAST_BLOCKS of them and by shuffle beyond.
Looked up are only starts of a length that the list holds: if it has hosts of two and three labels and paths of no part and of four, then
each URL's last two and three labels, alone and with its first four path parts. So no bound is set on lengths, and no key such as a lone
top-level domain, which all URLs share, is made unless the list has one. Each distinct key is looked up once; hits are joined back.

Null urls and those without :// have an empty host and path and are allowed unless a rule says otherwise. Null and empty listed URLs
are left out. Repeated rows stay, other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import save

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A small example list of gambling, adult and spam sites; a real one comes as a table.
LISTED = tuple(f"{name}.example.{end}" for name in ("adult-x", "casino-win", "free-bets", "spam-farm") for end in ("com", "net", "org"))
#: Keys in a 64-bit block: with BITS bits for each, about 1 key in 40 that isn't listed passes.
KEYS_A_BLOCK, BITS = 6, 4
#: Blocks that are broadcast, 12 bytes each; a larger filter is joined by its block's number.
BROADCAST_BLOCKS = 1 << 20


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """Without user, port, leading www and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@|:[0-9]*\z|\.+\z", ""), r"\Awww\.(?=.)", "")


def path_parts(path: Column) -> Column:
    """The parts of a path; without empty ones, `.` and a last index page."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) > 0) & last.rlike(r"(?i)\A(?:index|default)\.[a-z]+\z"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def canonical_url(url: Column) -> Column:
    """host, or host/path, of a URL with or without a scheme; null where it has no host."""
    whole = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("://"), url))
    host, parts = canonical_host(host_of(whole)), path_parts(path_of(whole))
    return F.when(host != "", F.when(F.size(parts) > 0, F.concat(host, F.lit("/"), F.array_join(parts, "/"))).otherwise(host))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. One branch of a CASE for each rule, longest first."""
    out = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def bit_mask(key: Column) -> Column:
    """BITS bits of a 64-bit mask, each from 6 bits of a hash."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")))
    return mask


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def bloom_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """block, mask: the blocked Bloom filter of a column; at most `blocks` rows."""
    return keys.select(block_of(F.col(column), blocks).alias("block"), bit_mask(F.col(column)).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))


def domains(host: Column, sizes: list[int]) -> Column:
    """The host's ends with as many labels as sizes name: of a.b.c those of 2 and 3 are b.c and a.b.c."""
    labels = F.split(host, r"\.")
    fits = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.size(labels))
    return F.transform(fits, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def covering(host: Column, path: Column, labels: list[int], parts: list[int]) -> Column:
    """Canonical URLs that cover a URL: the ends of its canonical host with as many labels, followed by as many of its first path parts, as given."""
    own, steps = canonical_host(host), path_parts(path)
    fits = F.filter(F.array(*[F.lit(n) for n in parts]).cast("array<int>"), lambda n: n <= F.size(steps))
    starts = F.transform(fits, lambda n: F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/"))).otherwise(""))
    names = F.transform(domains(own, labels), lambda d: F.transform(starts, lambda p: F.concat(d, p)))
    return F.when(own != "", F.flatten(names)).otherwise(F.array().cast("array<string>"))


def listed_sizes(listed: DataFrame) -> tuple[list[int], list[int]]:
    """How many labels the hosts of a list have, and how many parts its paths: the distinct numbers, at most as many as the longest URL has places."""
    host, path = F.substring_index("listed", "/", 1), F.regexp_extract("listed", r"(?s)\A[^/]*/(.*)\z", 1)
    parts = F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))
    row = listed.agg(F.sort_array(F.collect_set(F.size(F.split(host, r"\.")))).alias("labels"), F.sort_array(F.collect_set(parts)).alias("parts")).first()
    return list(row["labels"]), list(row["parts"])


def listed_table(listed: DataFrame, column: str = "listed") -> DataFrame:
    """The distinct canonical URLs of a column."""
    return listed.select(canonical_url(F.trim(F.col(column).cast("string"))).alias("listed")).where("listed is not null").distinct()


def listed_hosts(spark: SparkSession, hosts: tuple[str, ...] = LISTED) -> DataFrame:
    return spark.createDataFrame([(h,) for h in hosts], "listed string")


def listed_keys(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """keys(key), listed(listed: canonical URLs) -> the distinct keys that the list holds: those that pass its filter and are then found in it."""
    blocks = max(1, -(-listed.count() // KEYS_A_BLOCK))
    filled = bloom_blocks(listed, "listed", blocks)
    near = keys.select("key").distinct().withColumn("block", block_of(F.col("key"), blocks)).join(F.broadcast(filled) if blocks <= BROADCAST_BLOCKS else filled, "block")
    passed = near.where(bit_mask(F.col("key")).bitwiseAND(F.col("mask")) == bit_mask(F.col("key"))).select("key")
    return passed.join(listed.hint("shuffle_hash"), passed["key"] == listed["listed"], "left_semi")


def covered_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """urls(host, path), listed(listed: canonical URLs) -> the distinct urls that a listed one covers."""
    labels, parts = listed_sizes(listed)
    # A URL of many pages is looked up once, and so is a key of many URLs.
    keys = urls.distinct().select("host", "path", F.explode(covering(F.col("host"), F.col("path"), labels, parts)).alias("key"))
    hits = save(listed_keys(keys, listed), "hits")
    return keys.join(hits, "key", "left_semi").select("host", "path").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages(page_id, url, ...), listed(listed: URLs or hosts) -> page_id, host, path, rule, verdict. One row for each page."""
    spark = pages.sparkSession
    known = save(listed_table(listed if listed is not None else listed_hosts(spark)), "list")
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    asked = parsed.where("r is null")
    hits = save(covered_urls(asked.select("host", "path"), known), "covered").withColumn("hit", F.lit(True))
    # Pages whose rule decides need no look-up.
    method = asked.join(hits, ["host", "path"], "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    return parsed.where("r is not null").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")).unionByName(method)


ORACLE = f"""
with p as (select page_id,
    case when url like '%://%' then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
rules(h, s, v) as (values {", ".join(str(r) for r in RULES)}),
fit as (select page_id, host, path, max_by(h || s, length(h || s)) as rule, max_by(v, length(h || s)) as v
    from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by all),
bad as (select distinct host from p join (values {", ".join(f"('{h}')" for h in LISTED)}) l(b) on host = b or ends_with(host, '.' || b))
select p.page_id, p.host, p.path, f.rule, coalesce(f.v, case when b.host is not null then 'block' else 'allow' end) as verdict
from p left join (select distinct * from fit) f on p.page_id = f.page_id and p.host = f.host and p.path = f.path left join bad b on p.host = b.host
"""
