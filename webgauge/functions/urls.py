"""URL functions as column expressions over http(s) URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.constants import (
    AUTHORITATIVE_HOSTS,
    AUTHORITATIVE_TLDS,
    NON_HTML,
    SESSION_PARAMS,
    SHARE_LINKS,
    SOCIAL_HOSTS,
    TRACKING_CRAWL,
    TRACKING_LINKS,
)

#: scheme, user info, host, port, path, query, fragment
PARTS = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def is_web(url: Column) -> Column:
    return F.regexp_like(url, F.lit(PARTS))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def full_host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host(url: Column) -> Column:
    """Host in lower case without www.; empty where there is none."""
    return F.coalesce(F.regexp_replace(full_host(url), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    p = _part(url, 4)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    return _part(url, 5)


def path_and_query(url: Column) -> Column:
    return F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def fragment(url: Column) -> Column:
    return _part(url, 6)


def origin(url: Column) -> Column:
    port = _part(url, 3)
    usual = (port == "") | ((scheme(url) == "https") & (port == "443")) | ((scheme(url) == "http") & (port == "80"))
    return F.concat(scheme(url), F.lit("://"), full_host(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))


def normalize(text: Column) -> Column:
    """What a user typed as a URL: https is assumed, the host needs a dot; null if it isn't one."""
    t = F.trim(text)
    full = F.when(F.regexp_like(t, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")), t).otherwise(F.concat(F.lit("https://"), t))
    whole = F.concat(origin(full), path_and_query(full), F.when(fragment(full) != "", F.concat(F.lit("#"), fragment(full))).otherwise(""))
    return F.when(is_web(full) & F.contains(full_host(full), F.lit(".")), whole)


def params(url: Column) -> Column:
    """Keys of the query in order, repeats included."""
    return F.filter(F.transform(F.split(query(url), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))), lambda k: k != "")


def canonical(url: Column) -> Column:
    """Identity of a page in a crawl: no fragment, no parameter that is a tracking name, one trailing slash less."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.regexp_like(F.split_part(p, F.lit("="), F.lit(1)), F.lit(TRACKING_CRAWL)))
    q = F.concat_ws("&", kept)
    p = path(url)
    p = F.when((F.length(p) > 1) & F.endswith(p, F.lit("/")), F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(is_web(url), F.concat(origin(url), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def strip_hash(url: Column) -> Column:
    return F.regexp_replace(F.split_part(url, F.lit("#"), F.lit(1)), "/$", "")


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL from a link on ``base``: absolute, scheme-relative, root-relative, query, fragment or relative."""
    h = F.trim(href)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    merged = F.when(F.startswith(h, F.lit("/")), h).otherwise(F.concat(folder, h))
    no_dots = F.regexp_replace(F.regexp_replace(merged, r"/\./", "/"), r"/[^/?#]+/\.\.(?=/|$)", "")
    return (
        F.when((h == "") | h.isNull(), F.lit(None).cast("string"))
        .when(F.regexp_like(h, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("#")), F.concat(F.split_part(base, F.lit("#"), F.lit(1)), h))
        .when(F.startswith(h, F.lit("?")), F.concat(origin(base), path(base), h))
        .otherwise(F.concat(origin(base), no_dots))
    )


def same_site(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def is_page(url: Column) -> Column:
    """Not a path that ends like a file of another kind."""
    return ~F.regexp_like(path(url), F.lit(NON_HTML))


def dynamic_params(keys: Column) -> Column:
    return F.filter(keys, lambda k: ~F.regexp_like(k, F.lit(TRACKING_LINKS)))


def has_session(keys: Column) -> Column:
    return F.exists(keys, lambda k: F.regexp_like(k, F.lit(SESSION_PARAMS)))


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def labels(url: Column) -> Column:
    return F.split(full_host(url), r"\.")


def in_hosts(h: Column, hosts: list[str]) -> Column:
    """The host itself or a subdomain of one."""
    return F.exists(F.array(*[F.lit(x) for x in hosts]), lambda x: (h == x) | F.endswith(h, F.concat(F.lit("."), x)))


def is_social(url: Column) -> Column:
    return in_hosts(host(url), SOCIAL_HOSTS)


def is_share_link(href: Column) -> Column:
    return F.regexp_like(href, F.lit(SHARE_LINKS))


def is_authoritative(h: Column) -> Column:
    bare = F.regexp_replace(F.lower(h), r"^www\.", "")
    return F.regexp_like(bare, F.lit(r"\.(" + "|".join(AUTHORITATIVE_TLDS) + ")$")) | in_hosts(bare, AUTHORITATIVE_HOSTS)


def www_variant(url: Column) -> Column:
    """The other spelling of the host; null for hosts of several labels that don't begin with www."""
    h = full_host(url)
    n = F.size(labels(url))
    return F.when(F.startswith(h, F.lit("www.")), F.regexp_replace(h, r"^www\.", "")).when(n == 2, F.concat(F.lit("www."), h))


def shown(url: Column, own: Column) -> Column:
    """For display: path, query and fragment of an address of the origin ``own``, host and path of any other; what is no
    address as it is."""
    asked = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    part = F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise("")
    there = F.regexp_replace(origin(url), "^https?://", "")
    return F.when(~is_web(url), url).when(origin(url) == own, F.concat(path(url), asked, part)).otherwise(F.concat(there, F.when(path(url) == "/", "").otherwise(path(url)), asked))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(path(url), "/"), -1)
