"""URL filters: rules by host and path, then a list of canonical URLs.

The list becomes a blocked Bloom filter: a URL sets or tests eight bits of one 256-bit block, so a
test is one lookup. The filter has a bounded number of blocks and is broadcast; what it lets
through goes to an exact join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import stored, table
from chatseam.llm.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Blocks of 32 bytes: 4 MB of filter at most, however long the list.
MOST_BLOCKS = 1 << 17
BITS_A_URL = 12

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as they stand in the URL; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking fields, sorted; no scheme, no fragment."""
    host, path = host_and_path(url)
    fields = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(fields, lambda f: (f != "") & ~f.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    return F.concat(
        F.regexp_replace(host, r"^www\.", ""),
        F.regexp_replace(path, r"/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like ``net/es/``) and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Eight bits, one in each 32-bit lane, as four words."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("bigint")

    def lane(k: int) -> Column:
        place = F.shiftrightunsigned(bits, 5 * k).bitwiseAND(F.lit(31)).cast("int")
        return F.call_function("shiftleft", one, place + 32 * (k % 2))

    return [lane(2 * k).bitwiseOR(lane(2 * k + 1)) for k in range(4)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``_block, _w0 .. _w3`` of the blocks that have bits; ``listed`` has ``_canonical``."""
    words = {f"_w{k}": mask for k, mask in enumerate(_masks(F.col("_canonical")))}
    return (
        listed.select(_block(F.col("_canonical"), blocks).alias("_block"), *(m.alias(k) for k, m in words.items()))
        .groupBy("_block")
        .agg(*(F.bit_or(k).alias(k) for k in words))
    )


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, bits_a_url: int = BITS_A_URL) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``listed`` has the column ``url``. The longest fitting rule decides; without one, a page whose
    canonical URL is listed is blocked, any other is allowed. Null URLs and URLs without ``://``
    have empty host and path, fit no rule and are allowed; such rows of the list are ignored.
    Repeated pages each come back, repeated list rows count once. Either table may be empty.
    """
    entries = stored(
        listed.where(F.instr("url", "://") > 0).select(canonical(F.col("url")).alias("_canonical")).distinct()
    )
    blocks = max(1, min(MOST_BLOCKS, entries.count() * bits_a_url // 256 + 1))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("_host"), path.alias("_path"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.select(
        "page_id", "_host", "_path", rule.alias("_rule"), verdict.alias("_verdict"), canonical(F.col("url")).alias("_canonical")
    ).withColumn("_block", _block(F.col("_canonical"), blocks))
    tested = rows.join(F.broadcast(bloom_filter(entries, blocks)), "_block", "left")
    hit = F.col("_verdict").isNull() & (F.col("_host") != "")
    for k, mask in enumerate(_masks(F.col("_canonical"))):
        hit &= F.col(f"_w{k}").bitwiseAND(mask) == mask
    tested = tested.withColumn("_possible", F.coalesce(hit, F.lit(False)))
    columns = ["page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule")]
    passed = tested.where("not _possible").select(*columns, F.coalesce("_verdict", F.lit("allow")).alias("verdict"))
    exact = tested.where("_possible").join(entries.withColumn("_listed", F.lit(True)), "_canonical", "left")
    return passed.unionByName(exact.select(*columns, F.when(F.col("_listed"), "block").otherwise("allow").alias("verdict")))


_CANONICAL_SQL = r"""
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END"""


@query(
    "op4_urls",
    rf"""
    WITH parts AS (
      SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
               lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS fields
      FROM parts),
    named AS (SELECT *, {_CANONICAL_SQL} AS canonical FROM split),
    listed AS (SELECT DISTINCT canonical FROM named JOIN labels ON page_id = doc_id WHERE toxic = 1 AND host <> ''),
    ruled AS (
      SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM named)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN canonical IN (SELECT canonical FROM listed) AND host <> '' THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled
    """,
)
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the URLs of pages whose id is labelled toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    return judge_urls(pages, pages.join(toxic, "page_id").select("url"))
