"""Scalar URL functions as Spark columns, and the two that need a parser as Arrow functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IP = r"^\d{1,3}(\.\d{1,3}){3}$|^\[|:.*:"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    """host[:port] with user information, as written: the name of a website."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path(url: Column) -> Column:
    """The path; / for none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    """The query with its question mark; empty for none."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)


def base_domain(url: Column) -> Column:
    """The last two labels of a host of three or more; addresses stay whole."""
    h = host(url)
    return F.when(h.rlike(_IP), h).otherwise(F.substring_index(h, ".", -2))


def root_path(url: Column) -> Column:
    """The path up to the last slash before its first dot; without a dot the whole path."""
    p = path(url)
    return F.when(F.locate(".", p) > 1, F.regexp_extract(p, r"^([^.]*/)", 1)).otherwise(p)


def storage_name(url: Column, scope: str) -> Column:
    """The directory a crawl of this scope is kept in."""
    if scope == "domain":
        return base_domain(url)
    if scope == "subdomain":
        return host(url)
    return F.replace(F.concat(host(url), root_path(url)), F.lit("/"), F.lit("_"))


def file_path(url: Column) -> Column:
    """The file of a page below its site: directories, file name or a default, a hash of the query."""
    p = F.substring(sanitised(path(url)), 2, 1_000_000)
    p = F.when((p == "") | p.endswith("/"), F.concat(p, F.lit("_default_"))).otherwise(p)
    q = query(url)
    tail = F.when(F.length(q) > 1, F.concat(F.lit("_"), F.upper(F.md5(q)))).otherwise("")
    return F.concat(p, tail, F.lit(".nlp.txt"))


def sanitised(p: Column) -> Column:
    """A path decoded, with characters file systems refuse as underscores."""
    decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    return F.regexp_replace(F.regexp_replace(decoded, r'[<>:"|?*\\\x00-\x1f]', "_"), r"\.+/", "/")


def flat_name(url: Column) -> Column:
    """host__path in one name of at most 100 characters."""
    rest = F.replace(F.concat(path(url), query(url)), F.lit("/"), F.lit("_"))
    return F.substring(F.concat(host(url), F.lit("_"), F.regexp_replace(rest, r'[<>:"|?*\\]', "_")), 1, 100)


def key64(url: Column) -> Column:
    """The first eight bytes of the URL's MD5 as a little-endian signed number."""
    digest = F.md5(url)
    swapped = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    return F.conv(swapped, 16, -10).cast("bigint")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def repaired_redirect(location: Column) -> Column:
    """A redirect target without fragment and trailing escaped spaces."""
    return F.regexp_replace(F.regexp_replace(without_fragment(location), r"%20$", ""), r"\s+$", "")


def in_scope(url: Column, root: Column, scope: Column) -> Column:
    """Is the URL inside the domain, sub-domain or path of the root?"""
    return (
        F.when(scope == "domain", base_domain(url) == base_domain(root))
        .when(scope == "subdomain", host(url) == host(root))
        .when(scope == "path", (host(url) == host(root)) & F.startswith(path(url), root_path(root)))
        .otherwise(F.lit(False))
    )


@F.arrow_udf(T.StringType())
def resolved(base: pa.Array, href: pa.Array) -> pa.Array:
    """The absolute form of a reference, without fragment; null if it can't be read."""
    out = []
    for b, h in zip(base.to_pylist(), href.to_pylist()):
        try:
            out.append(urljoin(b or "", (h or "").strip()).split("#", 1)[0] or None if h is not None else None)
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


def base_href(page_url: Column, href: Column) -> Column:
    """The base of relative links: // gets the page's scheme, a relative base is ignored."""
    return F.when(href.startswith("//"), F.concat(scheme(page_url), F.lit(":"), href)).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).otherwise(page_url)
