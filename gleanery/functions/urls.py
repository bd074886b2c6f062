"""URL columns: normal form, article test, id and feed address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import strip

# The article section and what it excludes.
ARTICLE_PREFIX = "/news/"
EXCLUDED_PREFIXES = (
    "/news/category",
    "/news/author/",
    "/news/tag/",
    "/news/archive",
    "/news/writer-archive",
    "/news/newsletters",
)
EXCLUDED_SLUGS = ("news", "home")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def _without_dot_segments(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(
            part == "..",
            F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
        )
        .when(part == ".", acc)
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def normalise_url(url: Column, base: str, site: str, host_match: str = "contains") -> Column:
    """Absolute http(s) URL on ``site`` without query, fragment and trailing slash, else null.

    Relative addresses are resolved against the root of ``base``. ``host_match``
    is ``contains`` (the host holds the site name anywhere) or ``domain`` (the
    host is the site or one of its subdomains).
    """
    scheme, _, rest = base.partition("://")
    origin = f"{scheme}://{rest.split('/')[0]}"
    raw = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    bare = F.regexp_extract(raw, r"^([^?#]*)", 1)
    absolute = (
        F.when(raw.rlike(_SCHEME), raw)
        .when(raw.startswith("//"), F.concat(F.lit(f"{scheme}:"), raw))
        .when(raw.startswith("/"), F.concat(F.lit(origin), _without_dot_segments(bare)))
        .otherwise(
            F.concat(
                F.lit(f"{origin}/"),
                F.ltrim(_without_dot_segments(F.concat(F.lit("/"), F.regexp_replace(bare, "/+", "/"))), F.lit("/")),
            )
        )
    )
    found_scheme = F.lower(F.regexp_extract(absolute, _ABSOLUTE, 1))
    host = F.regexp_extract(absolute, _ABSOLUTE, 2)
    path = F.regexp_replace(F.regexp_extract(absolute, _ABSOLUTE, 3), r";[^/]*$", "")
    path = F.rtrim(path, F.lit("/"))
    if host_match == "contains":
        on_site = host.contains(site)
    elif host_match == "domain":
        name = F.lower(F.regexp_extract(host, r"([^@:]*)(?::\d*)?$", 1))
        on_site = (name == site) | name.endswith(f".{site}")
    else:
        raise ValueError(f"host_match must be 'contains' or 'domain', not {host_match!r}")
    return F.when(
        found_scheme.startswith("http") & on_site & (path != ""),
        F.concat(found_scheme, F.lit("://"), host, path),
    )


def url_path(url: Column) -> Column:
    """Path of an absolute URL without trailing slashes."""
    return F.rtrim(F.regexp_extract(url, _ABSOLUTE, 3), F.lit("/"))


def is_article_url(
    url: Column,
    prefix: str = ARTICLE_PREFIX,
    excluded_prefixes: Sequence[str] = EXCLUDED_PREFIXES,
    excluded_slugs: Sequence[str] = EXCLUDED_SLUGS,
) -> Column:
    """True when a normalised URL points at one article of the section ``prefix``."""
    path = url_path(url)
    slug = F.substring_index(path, "/", -1)
    keep = path.startswith(prefix) & (slug != "") & ~slug.isin(*excluded_slugs)
    for excluded in excluded_prefixes:
        keep = keep & ~path.startswith(excluded)
    return keep


def url_id(url: Column) -> Column:
    """Last path segment of a URL."""
    return F.substring_index(url_path(url), "/", -1)


def feed_address(channel_url: Column, prefix: str) -> Column:
    """Feed address of a channel: ``prefix`` plus the last part of the channel address."""
    return F.concat(F.lit(prefix), F.substring_index(channel_url, "/", -1))
