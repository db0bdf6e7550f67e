"""URL projections."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_HOST = "https://github.com"
RAW_HOST = "https://raw.githubusercontent.com"


def to_raw_url(url: Column, site_host=SITE_HOST, raw_host=RAW_HOST) -> Column:
    """URL of the bare file body: every ``blob/`` dropped, raw host."""
    return F.replace(F.replace(url, F.lit("blob/"), F.lit("")), F.lit(site_host), F.lit(raw_host))


def to_contents_url(pre_url: str, full_name: Column, path: Column) -> Column:
    """Content API URL of a file in a repository."""
    return F.concat(F.lit(pre_url), full_name, F.lit("/contents/"), path)


def to_blob_url(raw_url: Column, site_host=SITE_HOST, raw_host=RAW_HOST) -> Column:
    """Site URL of a raw URL: site host, ``/blob`` after the repository segment."""
    site = F.replace(raw_url, F.lit(raw_host), F.lit(site_host))
    return F.regexp_replace(site, r"^([^/]*/[^/]*/[^/]*/[^/]*/[^/]*)", "$1/blob")


def url_segment(url: Column, n: int) -> Column:
    return F.get(F.split(url, "/"), F.lit(n))


def url_owner(url: Column) -> Column:
    return url_segment(url, 3)


def url_repo(url: Column) -> Column:
    return url_segment(url, 4)


def url_extension(url: Column) -> Column:
    """Text after the last dot of the whole URL; the whole URL without a dot."""
    return F.substring_index(url, ".", -1)


def blob_file_path(html_url: Column) -> Column:
    """Path inside the repository of ``host/owner/repo/blob/ref/path``."""
    return F.regexp_extract(html_url, r"^[^/]*/[^/]*/[^/]*/[^/]*/[^/]*/[^/]*/[^/]*/(.*)$", 1)


def raw_file_path(raw_url: Column) -> Column:
    """Path inside the repository of ``host/owner/repo/ref/path``."""
    return F.regexp_extract(raw_url, r"^[^/]*/[^/]*/[^/]*/[^/]*/[^/]*/[^/]*/(.*)$", 1)


def contents_file_path(contents_url: Column) -> Column:
    """Path inside the repository of a content API URL."""
    return F.get(F.split(contents_url, "/contents/"), F.lit(1))
