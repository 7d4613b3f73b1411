"""Text expressions shared by sources and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A parameter is masked if its key, in lower case without - and _, contains one of these.
SENSITIVE = ("token", "secret", "password", "apikey", "authorization", "cookie", "session", "credential")

#: A field is masked if its path, in lower case without - and _, contains one of these.
SENSITIVE_FIELDS = ("password", "passcode", "secret", "token", "ssn", "socialsecurity", "bankaccount")


def masked_field(path: Column, value: Column) -> Column:
    """The value, or ``***`` where the field's path is sensitive."""
    return F.when(F.regexp_replace(F.lower(path), "[-_]", "").rlike("|".join(SENSITIVE_FIELDS)), F.lit("***")).otherwise(value)


def base_name(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _parameter(p: Column) -> tuple[Column, Column]:
    key = F.substring_index(p, "=", 1)
    plain = F.regexp_replace(F.lower(key), "[-_]", "")
    return key, plain.rlike("|".join(SENSITIVE))


def _split_url(url: Column) -> tuple[Column, Column, Column]:
    return F.regexp_extract(url, r"^([^?#]*\??)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)


def mask_url(url: Column) -> Column:
    """The address with the values of sensitive query parameters replaced by ``***``."""
    head, query, tail = _split_url(url)

    def masked(p: Column) -> Column:
        key, hit = _parameter(p)
        return F.when(hit, F.concat(key, F.lit("=***"))).otherwise(p)

    return F.concat(head, F.array_join(F.transform(F.split(query, "&"), masked), "&"), tail)


def masked_parameters(url: Column) -> Column:
    """How many parameters ``mask_url`` replaces."""
    return F.size(F.filter(F.split(_split_url(url)[1], "&"), lambda p: _parameter(p)[1]))


def percent(hit: Column, found: Column) -> Column:
    """Share with one decimal, a dash where nothing was found."""
    return F.when(found > 0, F.format_string("%.1f%%", hit * 100.0 / found)).otherwise("—")
