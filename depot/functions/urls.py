"""URL normalisation, keys and content fingerprints (no UDF)."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depot.functions import fixed
from depot.functions.versions import _col

# scheme://authority, then the path up to a query or fragment
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def host(url) -> Column:
    """Lower-case host of a URL without user part and port; empty if there is none."""
    authority = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""))


def resolve_dots(path) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    path = _col(path)
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(kept, tail), "/")
    # popping the empty first segment loses the leading slash
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.contains("/."), rooted).otherwise(path)


def is_presigned(url, hosts: Sequence[str] = tuple(fixed.PRESIGNED_HOSTS)) -> Column:
    """Whether the host is one of ``hosts`` or a storage endpoint (one regex per URL)."""
    part, suffix = re.escape(fixed.PRESIGNED_HOST_PART), re.escape(fixed.PRESIGNED_HOST_SUFFIX[1:])
    # the dot that ends the part may be the one that starts the suffix
    names = [re.escape(h) for h in hosts] + [rf"[^/?#:@]*{part}(?:[^/?#:@]*\.)?{suffix}"]
    pattern = rf"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(?:{'|'.join(names)})(?::[0-9]*)?(?:[/?#]|$)"
    return _col(url).rlike(pattern)


def normalize_url(url, hosts: Sequence[str] = tuple(fixed.PRESIGNED_HOSTS)) -> Column:
    """Drop params, query and fragment of presigned URLs; leave every other URL alone.

    A presigned URL with an empty path is unchanged as well.
    """
    return F.coalesce(_normal(url, hosts), _col(url))


def _normal(url, hosts: Sequence[str]) -> Column:
    """The normalised URL; null for one that is left alone."""
    url = _col(url)
    origin = F.regexp_extract(url, _ORIGIN, 1)
    path = F.regexp_extract(url, _ORIGIN + r"([^?#]*)", 2)
    path = F.regexp_replace(path, ";[^/]*$", "")
    return F.when(is_presigned(url, hosts) & (path != ""), F.concat(origin, resolve_dots(path)))


def with_normal_url(
    df: DataFrame, url: str, name: str, hosts: Sequence[str] = tuple(fixed.PRESIGNED_HOSTS)
) -> DataFrame:
    """Add ``name``: :func:`normalize_url` of a column, taken once for each distinct stem.

    What a URL becomes depends on what stands before its query and fragment alone, and
    signed URLs of one object differ only there. So the stems, few beside the requests,
    are normalised and looked up.
    """
    stem = F.substring_index(F.substring_index(F.col(url), "?", 1), "#", 1)
    stems = df.select(stem.alias("_stem")).distinct()
    normal = stems.select("_stem", _normal("_stem", hosts).alias("_normal")).where("_normal is not null")
    found = df.withColumn("_stem", stem).join(normal, "_stem", "left")
    return found.withColumn(name, F.coalesce("_normal", url)).drop("_stem", "_normal")


def url_key(url) -> Column:
    """sha256 of the URL text: the name of its cached object."""
    return F.sha2(_col(url), 256)


def short_key(text) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, 8)


def content_fingerprint(
    url, size, etag, modified, hosts: Sequence[str] = tuple(fixed.PRESIGNED_HOSTS), normalized: bool = False
) -> Column:
    """sha256 of ``url|size|etag|modified``; a missing header counts as ``None``.

    ``normalized`` says that the URL is one already, so that it is not taken apart again.
    """
    parts = [
        _col(url) if normalized else normalize_url(url, hosts),
        _col(size).cast("string"),
        _col(etag),
        _col(modified),
    ]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]), 256)
