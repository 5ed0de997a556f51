"""Clinical significance, and the rule that hides common and uninformative variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significance terms that are always shown.
PROTECTED_TERMS = (
    "pathogenic",
    "likely pathogenic",
    "risk factor",
    "drug response",
    "conflicting interpretations of pathogenicity",
)
COMMON_FREQUENCY = 0.05


def spaced(text: Column) -> Column:
    """Underscores to spaces."""
    return F.translate(text, "_", " ")


def clinical_struct(clnsig: Column, clndn: Column, clnrevstat: Column) -> Column:
    """Readable significance, condition and review status; NULL without a significance."""

    def readable(text: Column) -> Column:
        return F.when((text != "") & (text != "."), spaced(text))

    return F.when(
        (clnsig != "") & (clnsig != "."),
        F.struct(
            spaced(clnsig).alias("significance"),
            readable(clndn).alias("condition"),
            readable(clnrevstat).alias("review_status"),
        ),
    )


def significance_terms(significance: Column) -> Column:
    """Lower-case terms between ``/`` and ``,``; an empty array where there are none."""
    terms = F.transform(F.split(F.lower(significance), "[/,]"), lambda part: F.trim(part))
    return F.coalesce(F.filter(terms, lambda term: term != ""), F.array().cast("array<string>"))


def matches_significance(clnsig: Column, term: str) -> Column:
    """Case-insensitive substring on the raw (underscored) significance."""
    return F.lower(clnsig).contains(term.lower())


def is_suppressed(is_protected: Column, impact: Column, clnsig: Column, af: Column) -> Column:
    """True for a variant the smart filter hides.

    Known drug-gene variants, HIGH impact and protected significance terms always stay. Otherwise a
    known frequency hides common variants whose terms are all benign or missing, and an unknown
    frequency hides variants without terms.
    """
    terms = significance_terms(spaced(F.when(clnsig != ".", clnsig)))
    shown = is_protected | (F.upper(impact) == "HIGH") | F.arrays_overlap(terms, F.array(*map(F.lit, PROTECTED_TERMS)))
    no_terms = F.size(terms) == 0
    only_benign = F.forall(terms, lambda term: term.contains("benign"))
    hidden = F.when(af.isNull(), no_terms).otherwise((af > COMMON_FREQUENCY) & only_benign)
    return F.when(F.coalesce(shown, F.lit(False)), F.lit(False)).otherwise(hidden)
