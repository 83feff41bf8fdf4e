"""URL filters: rules by host and path, then a blocked Bloom filter of listed URLs before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PER_BLOCK = 16  # listed URLs in a block of 256 bits: 16 bits for each
BROADCAST_BLOCKS = 1 << 18  # about 20 MB of blocks; a larger filter is joined by shuffle


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without closing slash, and the query's parameters but for tracking, sorted.

    Scheme and fragment don't count. Null for a null url or one without ``://``.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)"))
    tail = F.array_join(F.array_sort(kept), "&")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def _rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct (length, rule, verdict); else null."""
    fitting = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """A hash that names the key's block, and the two bits that it sets in each of the block's four words."""
    spread = F.xxhash64(F.lit(29), key)
    one = F.lit(1).cast("long")
    words = []
    for w in range(4):
        low, high = (F.shiftrightunsigned(spread, 12 * w + 6 * i).bitwiseAND(F.lit(63).cast("long")) for i in range(2))
        words.append(F.call_function("shiftleft", one, low.cast("int")).bitwiseOR(F.call_function("shiftleft", one, high.cast("int"))))
    return F.xxhash64(F.lit(31), key), words


def bloom_blocks(listed: DataFrame) -> tuple[DataFrame, int]:
    """The blocks (block, w0..w3) of a blocked Bloom filter over distinct keys (column ``key``), and how many there are."""
    count = max(1, -(-listed.count() // PER_BLOCK))
    place, words = _bits(F.col("key"))
    rows = listed.select(F.pmod(place, F.lit(count)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), count


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical_url, listed) for every page.

    rules are (verdict, host, path); a rule fits its host and all subdomains where the path starts with the rule's, and the longest
    (host and path together) gives the verdict. Without one, a page is blocked if its canonical URL is among ``listed`` (raw URLs,
    column url) and allowed if not. The blocked Bloom filter passes possible hits, in the rows' own place if its blocks fit
    a broadcast of 2**18 blocks and by a shuffle on the block if not; an exact join on the canonical URL removes
    the false ones. Null or malformed URLs have empty host and path, no rule, and are allowed. Repeated pages each come back; listed
    rows may repeat or be null.
    """
    url = F.col(url_col)
    seen = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key")
    )
    seen = seen.withColumn("r", _rule(rules, F.col("host"), F.col("path")))
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
    blocks, count = bloom_blocks(keys)
    place, words = _bits(F.col("key"))
    blocks = blocks.withColumnRenamed("block", "of_block")
    blocks = F.broadcast(blocks) if count <= BROADCAST_BLOCKS else blocks
    probed = seen.where("key IS NOT NULL").withColumn("block", F.pmod(place, F.lit(count)))
    probed = probed.join(blocks, F.col("block") == F.col("of_block"), "left")
    hit = F.lit(True)
    for i, w in enumerate(words):
        hit = hit & (F.col(f"w{i}").bitwiseAND(w) == w)
    probed = probed.select("page_id", "host", "path", "key", "r", F.coalesce(hit, F.lit(False)).alias("possible"))
    exact = probed.where("possible").join(keys.select(F.col("key").alias("listed_key")), F.col("key") == F.col("listed_key"), "left")
    exact = exact.select("page_id", "host", "path", "key", "r", F.col("listed_key").isNotNull().alias("listed"))
    sure = probed.where("NOT possible").drop("possible").withColumn("listed", F.lit(False))
    bare = seen.where("key IS NULL").withColumn("listed", F.lit(False))
    return exact.union(sure).union(bare).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        F.col("key").alias("canonical_url"), "listed",
    )
