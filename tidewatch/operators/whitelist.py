"""Address filters and the service whitelist."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cidr_range, ipv4
from ..functions.fixed import QUIET_CATEGORIES

SCHEMA = "kind string, lo long, hi long, ports array<int>, protos array<string>, name string"

# The default whitelist as (kind, address or block, ports, protocols, name);
# no ports or protocols means any.  NTP hosts are names: the caller supplies their addresses.
DNS_SERVERS = [
    "10.8.8.8", "10.8.8.13", "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112",
    "208.67.222.222", "208.67.220.220", "64.6.64.6", "64.6.65.6",
]
UPDATE_SERVICES = ["23.221.50.32", "104.16.0.0/12", "151.101.0.0/16", "185.125.188.0/22", "91.189.88.0/21"]
KNOWN_SERVICES = [
    ("13.107.21.200", 443, "Microsoft Services"), ("13.107.42.12", 443, "Microsoft Services"),
    ("185.125.190.18", 80, "Ubuntu Update Server"), ("185.125.190.18", 443, "Ubuntu Update Server"),
]
MULTICAST = ["224.0.0.0/24", "239.255.255.250", "224.0.0.251", "255.255.255.255"]
TRUSTED_INTERFACES = ["10.0.0.2"]
# IPv6 prefixes that are always whitelisted, and addresses skipped before scoring.
V6_PREFIXES = ["ff0", "ff02", "fe80"]
SKIP_DESTINATIONS = ["255.255.255.255", "224.0.0.251", "239.255.255.250", "224.0.0.252"]
SKIP_SOURCES = ["0.0.0.0", "0000:0000:0000:0000:0000:0000:0000:0000"]

Rule = tuple[str, str, list[int], list[str], str]


def default_rules(ntp_addresses: Iterable[str] = ()) -> list[Rule]:
    return [
        *[("interface", a, [], [], "trusted interface") for a in TRUSTED_INTERFACES],
        *[("dns", a, [53], [], "DNS server") for a in DNS_SERVERS],
        *[("ntp", a, [123], ["UDP", "TCP"], "NTP server") for a in ntp_addresses],
        *[("service", a, [p], [], name) for a, p, name in KNOWN_SERVICES],
        *[("update", a, [80, 443], [], "update service") for a in UPDATE_SERVICES],
        *[("multicast", a, [], [], "multicast") for a in MULTICAST],
    ]


def whitelist(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(kind, *cidr_range(a), ports, protos, name) for kind, a, ports, protos, name in rules], SCHEMA)


def extended(rules: DataFrame, more: DataFrame) -> DataFrame:
    """add rules; a rule that is there already (but for its name) is not added again."""
    return rules.unionByName(more.join(rules, ["kind", "lo", "hi", "ports", "protos"], "left_anti").dropDuplicates(["kind", "lo", "hi", "ports", "protos"]))


def in_cidr(address: Column, cidr: str) -> Column:
    """membership in one block; false for anything but IPv4."""
    low, high = cidr_range(cidr)
    return F.coalesce(ipv4(address).between(low, high), F.lit(False))


def _always(address: Column) -> Column:
    return F.coalesce(F.substring(address, 1, 3).isin("ff0") | F.substring(address, 1, 4).isin("fe80"), F.lit(False))


def _listed(flows: DataFrame, rules: DataFrame) -> tuple[DataFrame, Column]:
    """``flows`` with _ip and _cell, and whether a rule covers a flow: a range join by /16 blocks.

    A rule is copied to each /16 that it touches, so the plan is one hash or merge join on
    the block with the range as a further condition, for any number of rules, and adaptive
    execution broadcasts the rules while they are small.  Flows are read once.
    """
    cells = rules.select("lo", "hi", "ports", "protos", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("rule_cell"))
    numbered = flows.withColumn("_ip", ipv4(F.col("daddr"))).withColumn("_cell", F.shiftright("_ip", 16))
    outer = lambda c: F.col(c).outer()
    covers = (
        (outer("_cell") == F.col("rule_cell")) & outer("_ip").between(F.col("lo"), F.col("hi"))
        & ((F.size("ports") == 0) | F.array_contains(F.col("ports"), outer("dport")))
        & ((F.size("protos") == 0) | F.array_contains(F.col("protos"), outer("proto")))
    )
    return numbered, _always(F.col("daddr")) | cells.where(covers).exists()


def drop_whitelisted(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """F8: flows (daddr, dport, proto) to no whitelisted service."""
    numbered, listed = _listed(flows, rules)
    return numbered.where(~listed).drop("_ip", "_cell")


def mark_whitelisted(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """F8 as a column ``whitelisted``."""
    numbered, listed = _listed(flows, rules)
    return numbered.withColumn("whitelisted", listed).drop("_ip", "_cell")


def drop_sources(flows: DataFrame, local: Iterable[str] | DataFrame) -> DataFrame:
    """flows whose source is none of the local addresses (a list, or a table ``ip``)."""
    if isinstance(local, DataFrame):
        return flows.join(local.select(F.col("ip").alias("_local")).distinct(), F.col("saddr") == F.col("_local"), "left_anti")
    return flows.filter(F.coalesce(~F.col("saddr").isin(list(local)), F.lit(True)))


def loud_alerts(alerts: DataFrame, category: str = "category") -> DataFrame:
    """signature alerts of other than the quiet categories; no category counts as other."""
    return alerts.filter(F.coalesce(~F.col(category).isin(QUIET_CATEGORIES), F.lit(True)))


def routable(flows: DataFrame) -> DataFrame:
    """no link-local, multicast, broadcast or unspecified addresses."""
    s, d = F.coalesce("saddr", F.lit("")), F.coalesce("daddr", F.lit(""))
    skip = s.startswith("fe80:") | s.startswith("ff") | d.startswith("ff0") | d.isin(SKIP_DESTINATIONS) | s.isin(SKIP_SOURCES)
    return flows.filter(~skip)


def attacks(scored: DataFrame) -> DataFrame:
    """F6."""
    return scored.filter("is_attack")
