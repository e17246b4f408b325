"""Web access-log analytics: volume, status codes, visitor geography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ip_number, log_bytes, log_minute, null_literal, valid_ipv4
from tidewatch.operators.ordered import bounded_frame, has_hot_key, running
from tidewatch.session import HOT_ROWS, cut

# Fixed value: the accepted log line.
LOG_LINE = (r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] '
            r'"(.+?)" (\d{3}) (\S+)(.*?)$')

#: Addresses are looked up in blocks of so many low bits.
BLOCK_BITS = 16

TAGS = ("Volume", "Status", "Geo")


def parse_access_log(df: DataFrame, line: str = "value") -> DataFrame:
    """Replace the log line by its fields; lines that do not match are dropped.

    One regular-expression pass writes the wanted groups separated by newlines,
    which a log line cannot hold, and a plain split takes them apart. The split
    feeds a generator: the optimizer would push a filter on plain columns down and
    evaluate the expression again for it.
    """
    fields = F.split(F.regexp_replace(F.col(line), LOG_LINE, "$1\n$4\n$5\n$6\n$7"), "\n")
    matched = F.filter(F.array(fields), lambda f: F.size(f) == 5)
    kept = [c for c in df.columns if c != line]
    return (df.select(*kept, F.explode(matched).alias("_f"))
            .select(*kept, F.col("_f")[0].alias("ip"),
                    F.col("_f")[1].alias("log_timestamp"),
                    log_minute(F.col("_f")[1]).alias("minute"),
                    F.col("_f")[2].alias("request"),
                    F.col("_f")[3].cast("int").alias("response"),
                    log_bytes(F.col("_f")[4]).alias("byte_size"))
            .filter(F.col("minute").isNotNull()))


def valid_addresses(df: DataFrame, ip: str = "ip") -> DataFrame:
    """Rows whose address is a strict dotted quad."""
    return df.filter(valid_ipv4(F.col(ip)))


def geo_lookup(df: DataFrame, geo: DataFrame, ip: str = "ip") -> DataFrame:
    """Add ``country`` and ``city`` of the longest network holding the address.

    Rows with an invalid address are dropped, addresses in no network keep the
    text ``null``. Nested networks are first turned into disjoint ranges, and ranges into
    their parts within blocks of addresses, so the lookup is one equality join on the
    block. Whether it is broadcast is left to the measured bytes of the ranges' table.
    """
    rows = valid_addresses(df, ip).withColumn("_ip", ip_number(F.col(ip)))
    parts = cut(range_parts(disjoint_ranges(geo)))
    # Ranges are disjoint: at most one part holds the address.
    found = rows.join(parts, (F.shiftright("_ip", BLOCK_BITS) == F.col("_block"))
                      & F.col("_ip").between(F.col("_lo"), F.col("_hi")), "left")
    return (found.withColumn("country", null_literal(F.col("_net.country")))
            .withColumn("city", null_literal(F.col("_net.city")))
            .drop("_ip", "_block", "_lo", "_hi", "_net"))


def disjoint_ranges(geo: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(lo, hi, net)``: the addresses whose longest network is ``net``, as ranges.

    Between neighbouring starts and ends of networks the answer is the same, so it is
    asked once per such point, by one equality per prefix length. Of equal networks the
    one with the greatest names counts.
    """
    nets = (geo.filter(F.col("net_start").isNotNull() & F.col("prefix_len").between(0, 32))
            .groupBy(F.col("prefix_len").cast("int").alias("prefix_len"),
                     F.expr("shiftright(cast(net_start as bigint), 32 - prefix_len)").alias("prefix"))
            .agg(F.max(F.struct("country", "city")).alias("net")))
    first = F.expr("shiftleft(prefix, 32 - prefix_len)")
    after = F.expr("shiftleft(prefix + 1, 32 - prefix_len)")
    points = (nets.select(F.explode(F.array(first, after)).alias("lo")).distinct()
              .filter(F.col("lo") < 1 << 32))
    # At most 33 values.
    lengths = [r[0] for r in nets.select("prefix_len").distinct().collect()]
    asked = F.array(*[F.struct(F.lit(n).alias("prefix_len"), F.shiftright("lo", 32 - n).alias("prefix"))
                      for n in lengths] or [F.struct(F.lit(None).cast("int").alias("prefix_len"),
                                                     F.lit(None).cast("long").alias("prefix"))])
    owners = (points.select("lo", F.inline(asked)).join(nets, ["prefix_len", "prefix"])
              .groupBy("lo").agg(F.max_by("net", "prefix_len").alias("net")))
    ends = bounded_frame(points, [], ["lo"], {"_next": lambda w: F.lead("lo").over(w)}, before=0,
                         after=1, hot_rows=hot_rows)
    return owners.join(ends, "lo").select(
        "lo", (F.coalesce("_next", F.lit(1 << 32)) - 1).alias("hi"), "net")


def range_parts(ranges: DataFrame) -> DataFrame:
    """Ranges cut at block edges: ``(_block, _lo, _hi, _net)``. As they are disjoint, there
    are at most as many parts as ranges and blocks together."""
    block = F.explode(F.sequence(F.shiftright("lo", BLOCK_BITS), F.shiftright("hi", BLOCK_BITS)))
    return ranges.select(block.alias("_block"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                         F.col("net").alias("_net"))


def running_volume(df: DataFrame, order: list[str], **kw) -> DataFrame:
    """One row per log row: requests so far in its minute, itself included."""
    return running(df, ["minute"], order, {"count": F.lit(1).cast("long")}, **kw)


def running_status(df: DataFrame, order: list[str], *, zero_based: bool = True,
                   **kw) -> DataFrame:
    """One row per log row: rows so far with its status code. The n-th emits
    ``n-1`` unless ``zero_based`` is off."""
    out = running(df, ["response"], order, {"count": F.lit(1).cast("long")}, **kw)
    return out.withColumn("count", F.col("count") - 1) if zero_based else out


def running_geo(df: DataFrame, order: list[str], *, hot: bool | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per located row: rows so far in its country and in its city."""
    one = F.lit(1).cast("long")
    if hot is None:
        hot = has_hot_key(df, ["country"], hot_rows)
    # A city is no larger than its country.
    city_hot = hot and has_hot_key(df, ["country", "city"], hot_rows)
    kw = {"hot_rows": hot_rows}
    out = running(df, ["country"], order, {"country_total": one}, hot=hot, **kw)
    return running(out, ["country", "city"], order, {"city_total": one}, hot=city_hot, **kw)


def volume_by_minute(df: DataFrame) -> DataFrame:
    return df.groupBy("minute").agg(F.count(F.lit(1)).alias("count"))


def status_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("response").agg(F.count(F.lit(1)).alias("count"))


def geo_rollup(df: DataFrame) -> DataFrame:
    """Totals per city, per country and overall, with ``level`` 0, 1, 3."""
    return (df.rollup("country", "city")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.grouping_id().cast("int").alias("level")))


def geo_totals(df: DataFrame) -> DataFrame:
    """City and country totals and the city's share in its country."""
    cities = df.groupBy("country", "city").agg(F.count(F.lit(1)).alias("city_total"))
    countries = cities.groupBy("country").agg(F.sum("city_total").alias("country_total"))
    return (cities.join(countries, "country")
            .withColumn("city_share", F.col("city_total") / F.col("country_total")))


def fan_out(df: DataFrame, tags=TAGS) -> DataFrame:
    """Each row once per tag."""
    return df.withColumn("tag", F.explode(F.array(*[F.lit(t) for t in tags])))


def split_by(df: DataFrame, tag: str = "tag", values=TAGS) -> dict[str, DataFrame]:
    """One branch per tag value."""
    return {v: df.filter(F.col(tag) == v) for v in values}


def merge(*dfs: DataFrame) -> DataFrame:
    """Branches as one table; columns a branch lacks are null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
