"""Fields of a VCF record's INFO column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelespan.functions.numbers import to_double


def info_field(info: Column, field: str) -> Column:
    """Value of the first ``field=`` entry: NULL if the field is missing, ``""`` if its value is empty.

    Plain substring search between semicolons, so ``AF`` never matches ``AF_grpmax`` and the
    expression stays inside generated code.
    """
    marker = f";{field}="
    fenced = F.concat(F.lit(";"), info)
    start = F.instr(fenced, marker)
    rest = F.substring(fenced, start + F.lit(len(marker)), F.length(fenced))
    return F.when(start > 0, F.substring_index(rest, ";", 1))


def effect_fields(ann: Column) -> Column:
    """First effect entry as a struct; NULL unless it has at least eleven parts."""
    parts = F.split(F.substring_index(ann, ",", 1), r"\|")
    names = {"gene": 3, "effect": 1, "impact": 2, "transcript": 6, "hgvs_c": 9, "hgvs_p": 10}
    fields = [F.get(parts, F.lit(index)).alias(name) for name, index in names.items()]
    return F.when(F.size(parts) >= 11, F.struct(*fields))


def first_frequency(raw: Column) -> Column:
    """First number of a comma list, NULL if there is none; the usual single value takes the short way."""
    numbers = F.filter(F.transform(F.split(raw, ","), lambda part: to_double(F.trim(part))), lambda value: value.isNotNull())
    return F.when(F.instr(raw, ",") == 0, to_double(F.trim(raw))).otherwise(F.get(numbers, F.lit(0)))


def frequency_struct(af: Column, af_grpmax: Column) -> Column:
    """Overall and highest-group frequency; NULL if both are unknown."""
    return F.when(af.isNotNull() | af_grpmax.isNotNull(), F.struct(af.alias("global"), af_grpmax.alias("popmax")))
