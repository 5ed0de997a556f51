"""Table schemas. Chromosomes are stored bare (1..22, X, Y, MT); ``chr`` is added only for display."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (item.split(":") for item in spec.split())])


SITE_KEY = ["chrom", "pos", "ref", "alt"]

# Folders of a call table laid out by genome; a fixed number, so that a genome's folder can be told from its label.
GENOME_BUCKETS = 256

CALLS = _schema("genome:s chrom:s pos:l id:s ref:s alt:s gt:s")
EFFECT_COLUMNS = ["gene", "effect", "impact", "transcript", "hgvs_c", "hgvs_p"]
CLINICAL_COLUMNS = ["clnsig", "clndn", "clnrevstat"]
FREQUENCY_COLUMNS = ["af", "af_grpmax"]
IDENTIFIER_COLUMNS = ["rsid", "rsid_source"]

ANNOTATIONS = _schema(
    "chrom:s pos:l ref:s alt:s rsid:s rsid_source:s gene:s effect:s impact:s transcript:s "
    "hgvs_c:s hgvs_p:s clnsig:s clndn:s clnrevstat:s af:d af_grpmax:d"
)
GENES = _schema("symbol:s name:s chrom:s start_pos:l end_pos:l strand:s")
PGX_DRUGS = _schema("drug_name:s gene:s guideline_source:s guideline_url:s clinical_summary:s cpic_level:s pgx_testing:s")
PGX_VARIANTS = _schema("gene:s rsid:s chrom:s pos:l ref:s alt:s star_allele:s function_impact:s notes:s")
PRS_WEIGHTS = _schema("prs_id:s trait:s rsid:s chrom:s pos:l effect_allele:s weight:d")
WARNING_GENES = _schema("symbol:s")
GWAS = _schema(
    "rsid:s chrom:s pos:l mapped_gene:s trait:s mapped_trait:s risk_allele:s risk_allele_freq:d "
    "p_value:d or_beta:d ci_text:s pubmed_id:s first_author:s study_accession:s"
)

# Header names of the seed files, in file order, with their types.
SEED_FILES = {
    "genes": _schema("symbol:s name:s chrom:s start:l end:l strand:s"),
    "pgx_drugs": PGX_DRUGS,
    "pgx_variants": PGX_VARIANTS,
    "prs_weights": PRS_WEIGHTS,
    "warning_genes": WARNING_GENES,
}

LAYERS = {
    "snpeff": EFFECT_COLUMNS,
    "clinvar": CLINICAL_COLUMNS,
    "gnomad": FREQUENCY_COLUMNS,
    "dbsnp": IDENTIFIER_COLUMNS,
}
