"""URL filter: rules, then a blocked Bloom filter in front of an exact join with a URL list.

The list is turned into a blocked Bloom filter by one aggregation: a URL's hash names a
block of four 64-bit words and sets two bits in each. A page's URL needs one look at one
block. What passes goes to an exact hash join with the list, which removes the false
positives; what does not pass never meets the list. Everything is DataFrame expressions.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.session import write_once

WORDS = 4
BITS_PER_URL = 16
#: The filter is broadcast up to this size; a larger one is joined by its block number.
BROADCAST_BYTES = 64 << 20
_BLOCK_BYTES = 8 * (WORDS + 1)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return F.translate(_part(url, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Host without default port, path without closing slashes, query without tracking; null without a host.

    Scheme and fragment are left out; ``utm_*`` and ``ref`` are tracking parameters.
    """
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.array_join(
        F.filter(
            F.split(F.substring(_part(url, 3), 2, 1 << 30), "&"),
            lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref="),
        ),
        "&",
    )
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, null if none does; rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = rule.host + rule.path
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _probe(url: str, blocks: int) -> tuple[Column, list[Column]]:
    """Block number of a URL and its bits in each of the block's words."""
    spot = F.expr(f"xxhash64(1, `{url}`)")

    def bit(k: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spot, 6 * k).bitwiseAND(F.lit(63)).cast("int"))

    return F.pmod(F.xxhash64(url), F.lit(blocks)), [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 .. w3)`` of the blocked Bloom filter of ``listed(url)``."""
    block, bits = _probe("url", blocks)
    marked = listed.select(block.alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(bits)))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def passes_bloom(urls: DataFrame, blocks: DataFrame, n_blocks: int, broadcast: bool) -> DataFrame:
    """``urls`` with a boolean ``hit``: false only for URLs that are certainly not listed."""
    block, bits = _probe("url", n_blocks)
    side = F.broadcast(blocks) if broadcast else blocks
    joined = urls.withColumn("block", block).join(side, "block", "left")
    hit = F.lit(True)
    for k, b in enumerate(bits):
        hit = hit & (F.col(f"w{k}").bitwiseAND(b) == b)
    return joined.withColumn("hit", F.col("url").isNotNull() & F.coalesce(hit, F.lit(False))).drop("block", *(f"w{k}" for k in range(WORDS)))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, possible_hit, listed``.

    ``listed`` holds URLs in any spelling. The verdict is that of the longest rule that
    fits; without one, ``block`` if the canonical URL is listed, else ``allow``.

    A URL that is null or lacks ``://`` has empty host and path, no rule and no canonical
    form, so it is allowed; such entries of ``listed`` are ignored. Null ids pass through
    and repeated rows each give a row. An empty list blocks nothing, an empty table gives
    an empty table. Other columns of either table play no part, whatever their names.
    """
    known = write_once(
        listed.select(canonical(F.col(listed_col).cast("string")).alias("url")).where("url is not null").distinct(), "listed"
    )
    n_blocks = max(1, -(-known.count() * BITS_PER_URL // (64 * WORDS)))
    blocks = bloom_blocks(known, n_blocks)
    url = F.col(url_col).cast("string")
    urls = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("url")
    )
    probed = passes_bloom(urls, blocks, n_blocks, n_blocks * _BLOCK_BYTES <= broadcast_bytes)
    exact = known.withColumn("found", F.lit(True)).hint("shuffle_hash")
    hits = probed.where("hit").join(exact, "url", "left")
    rest = probed.where("not hit").withColumn("found", F.lit(False))
    judged = hits.unionByName(rest).withColumn("found", F.coalesce("found", F.lit(False)))
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    return judged.select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("found"), "block").otherwise("allow")).alias("verdict"),
        F.col("hit").alias("possible_hit"), F.col("found").alias("listed"),
    )
