"""URLs and hosts as column expressions. None of them fails on a bad URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.fixed_values import TWO_LABEL_SUFFIXES


def authority(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.regexp_extract(rest, r"^[^/?#]*", 0)


def host_of(url: Column) -> Column:
    """Lower-cased host, without user and port; empty for null."""
    named = F.regexp_replace(authority(F.trim(url)), r"^.*@", "")
    bare = F.when(F.startswith(named, F.lit("[")), F.regexp_extract(named, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(named, r":[0-9]*$", ""))
    return F.coalesce(F.lower(bare), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def normalized(url: Column) -> Column:
    """Trimmed, with https:// before what has no http scheme."""
    bare = F.trim(url)
    return F.when(F.lower(bare).rlike(r"^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def rejected(url: Column) -> Column:
    """Why a target can't be scanned: empty, a scheme other than http and https, or no host; null for one that can."""
    bare = F.trim(F.coalesce(url, F.lit("")))
    other = bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://") & ~F.lower(bare).rlike(r"^https?://")
    return F.when(bare == "", "empty").when(other, "unsupported scheme").when(host_of(normalized(bare)) == "", "no host")


def origin(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)", 1), authority(url), F.lit("/"))


def is_loopback(host: Column) -> Column:
    return host.isin("localhost", "ip6-localhost", "::1") | host.rlike(r"^127(\.\d{1,3}){3}$")


def is_ipv4(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def tld(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.concat(F.lit("."), F.substring_index(host, ".", -1))).otherwise("")


def registrable(host: Column) -> Column:
    """The part of a host that is registered: two labels, three under a two-label suffix; addresses stay."""
    bare = F.regexp_replace(host, r"^\.+|\.+$", "")
    long = F.substring_index(bare, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(F.replace(bare, F.lit("."), F.lit("")).rlike(r"^\d+$"), bare).when(long, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def slug(text: Column, most: int, empty: str) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), 1, most), F.lit("")), F.lit(empty))
