"""URLs: canonical form, hosts, hashes of sets of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.text import collapse

# Query parameters that do not change what a link points at.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "ref_src"]


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def canonical_url(raw: Column) -> Column:
    """Scheme, lower-case host without www. and port, path without trailing slashes, query without
    tracking parameters; no fragment. Null where it does not parse."""
    url = F.trim(raw)
    host = F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", "")
    kept = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda q: (q != "") & ~F.split(q, "=")[0].isin(TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host.isNotNull() & (host != ""), F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def links_hash(urls: Column) -> Column:
    """One hash of a set of links, whatever their order, copies and tracking parameters."""
    known = F.filter(F.transform(urls, canonical_url), lambda u: u.isNotNull())
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(known)), "\n"), 256)


def compare_hash(topic: Column, domains: Column) -> Column:
    named = F.filter(F.transform(domains, lambda d: F.lower(F.trim(d))), lambda d: d != "")
    return F.sha2(F.concat(F.lower(collapse(topic)), F.lit("\u241f"), F.array_join(F.array_sort(F.array_distinct(named)), "\n")), 256)


def host_of(url_or_host: Column) -> Column:
    """Lower-case host without www. of a URL or of a bare host."""
    text = F.lower(F.trim(url_or_host))
    return F.regexp_replace(part(F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text)), "HOST"), r"^www\.", "")


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def user_domain(text: Column) -> Column:
    """A domain as a user typed it: scheme, www. and path off, then lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^https?://", ""), r"^www\.", "")
    return F.lower(F.regexp_replace(bare, r"/.*$", ""))


def is_contributor(url: Column, domain: str, path: str = "/sites/") -> Column:
    """A page of a host that ends in the domain, under a path that holds guest contributions."""
    return F.coalesce(F.lower(part(url, "HOST")).endswith(domain) & part(url, "PATH").contains(path), F.lit(False))
