"""URL normalisation, domains and uids."""

from pyspark.sql import Column, DataFrame, functions as F


def normalise_url(url: Column) -> Column:
    """Drop one scheme, then one ``www.``, then slashes at both ends; case and query stay."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"^www\.", "")
    return F.btrim(bare, F.lit("/"))


def domain_of(url_norm: Column) -> Column:
    """Leading non-slash run of a normalised URL, NULL if empty.  The one domain rule used here."""
    return F.nullif(F.regexp_extract(url_norm, r"^([^/]+)", 1), F.lit(""))


def host(url: Column) -> Column:
    """Network location of an absolute URL, port included."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def host_without_www(url: Column) -> Column:
    return F.replace(host(url), F.lit("www."), F.lit(""))


def url_uid(url: Column) -> Column:
    return F.md5(url)


def with_domain(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("url_norm", normalise_url(F.col(url))).withColumn("domain", domain_of(F.col("url_norm")))
