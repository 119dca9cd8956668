"""Path and target-framework functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """Slashes for backslashes, without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def common_directories(a: Column, b: Column) -> Column:
    """Leading directories two paths share."""
    x, y = directories(a), directories(b)
    n = F.least(F.size(x), F.size(y))
    return F.when(n < 1, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))))


def framework_family(tfm: Column) -> Column:
    """core (netN.0 from 5 on and netcoreapp), standard, or framework (net4x); null for anything else."""
    return (
        F.when(tfm.rlike(r"(?i)^netstandard\d"), "standard")
        .when(tfm.rlike(r"(?i)^(netcoreapp\d|net([5-9]|\d\d)\.\d)"), "core")
        .when(tfm.rlike(r"(?i)^net[1-4]\d{1,2}"), "framework")
    )


def framework_major(tfm: Column) -> Column:
    number = F.regexp_extract(tfm, r"(?i)^(?:netstandard|netcoreapp|net)(\d+)", 1)
    return F.when(framework_family(tfm) == "framework", F.substring(number, 1, 1)).otherwise(number).try_cast("int")


def framework_symbols(tfm: Column) -> Column:
    """Preprocessor symbols an SDK defines for netN.0: NET, NETN_0 and every NETk_0_OR_GREATER from 5."""
    major = framework_major(tfm)
    later = F.transform(F.sequence(F.lit(5), F.greatest(F.lit(5), major)), lambda k: F.concat(F.lit("NET"), k.cast("string"), F.lit("_0_OR_GREATER")))
    return F.when((framework_family(tfm) == "core") & (major >= 5), F.concat(F.array(F.lit("NET"), F.concat(F.lit("NET"), major.cast("string"), F.lit("_0"))), later)).otherwise(F.array().cast("array<string>"))
