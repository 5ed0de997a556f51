"""Registered queries, their oracles, and the tables they run on."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelespan import schemas
from allelespan.plans.cohort import Cohort
from allelespan.session import bound_tasks, shared_folder
from testbed import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Oracle-side readings of what the library computes, written in DuckDB SQL.
domain.VIEWS.update(
    {
        "o_calls": """
            SELECT *, CASE WHEN contains(gt, '.') THEN 'no call' ELSE array_to_string(alleles, '/') END AS display,
                   CASE WHEN contains(gt, '.') THEN 'no_call'
                        WHEN len(alleles) >= 2 AND alleles[1] = alleles[2] THEN CASE WHEN alleles[1] = ref THEN 'homozygous_ref' ELSE 'homozygous_alt' END
                        ELSE 'heterozygous' END AS zygosity
            FROM (SELECT *, list_transform(string_split_regex(gt, '[/|]'),
                         lambda x: coalesce(list_concat([ref], string_split(alt, ','))[try_cast(x AS integer) + 1], '?')) AS alleles
                  FROM d_calls) listed""",
        "o_annotated": """
            SELECT c.genome, c.chrom, c.pos, c.ref, c.alt, CASE WHEN a.chrom IS NOT NULL THEN a.rsid ELSE c.id END AS rsid, c.gt, c.display, c.zygosity,
                   a.rsid_source, a.gene, a.effect, a.impact, a.transcript, a.hgvs_c, a.hgvs_p, a.clnsig, a.clndn, a.clnrevstat, a.af, a.af_grpmax, c.s, c.k
            FROM o_calls c LEFT JOIN d_annotations a ON c.chrom = a.chrom AND c.pos = a.pos AND c.ref = a.ref AND c.alt = a.alt""",
        "o_first_calls": """
            SELECT * FROM o_calls QUALIFY row_number() OVER (PARTITION BY genome, chrom, pos ORDER BY ref, alt, gt) = 1""",
        "o_padded": "SELECT symbol, name, chrom, greatest(1, start_pos - 2000) AS start_pos, end_pos + 2000 AS end_pos FROM d_genes",
        "o_smart": """
            SELECT v.*, CASE
                WHEN p.rsid IS NOT NULL OR coalesce(v.impact, '') = 'HIGH' THEN false
                WHEN list_has_any(terms, ['pathogenic', 'likely pathogenic', 'risk factor', 'drug response', 'conflicting interpretations of pathogenicity']) THEN false
                WHEN v.af IS NOT NULL THEN v.af > 0.05 AND len(list_filter(terms, lambda t: NOT contains(t, 'benign'))) = 0
                ELSE len(terms) = 0 END AS suppressed
            FROM (SELECT *, list_filter(list_transform(string_split(replace(lower(replace(coalesce(clnsig, ''), '_', ' ')), '/', ','), ','), lambda t: trim(t)), lambda t: t <> '') AS terms
                  FROM o_annotated) v
            LEFT JOIN (SELECT DISTINCT gene, rsid FROM d_pgx_variants WHERE rsid IS NOT NULL) p ON p.gene = v.gene AND p.rsid = v.rsid""",
        "o_scored": """
            SELECT c.genome, w.prs_id, w.trait, w.rsid, w.chrom, w.pos, w.effect_allele, w.weight, c.display, c.zygosity,
                   CASE WHEN c.zygosity = 'no_call' THEN 0 ELSE len(list_filter(c.alleles, lambda a: a = w.effect_allele)) END AS dosage
            FROM d_prs w JOIN o_first_calls c ON w.chrom = c.chrom AND w.pos = c.pos""",
    }
)

GENOME_RANK = "CASE {0} WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'MT' THEN 25 ELSE coalesce(try_cast({0} AS integer), 99) END"


class Tables:
    """The domain tables of one scale factor, as the library expects them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        bound_tasks(spark)

    def sql(self, query: str) -> DataFrame:
        return domain.spark_sql(self.spark, self.sf_dir, query)

    def view(self, name: str) -> DataFrame:
        return domain.view(self.spark, self.sf_dir, name)

    def typed(self, name: str, schema) -> DataFrame:
        return self.view(name).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    @cached_property
    def sites(self) -> DataFrame:
        return self.view("d_sites")

    @cached_property
    def annotations(self) -> DataFrame:
        return self.typed("d_annotations", schemas.ANNOTATIONS)

    @cached_property
    def calls(self) -> DataFrame:
        return self.typed("d_calls", schemas.CALLS)

    @cached_property
    def genes(self) -> DataFrame:
        return self.typed("d_genes", schemas.GENES)

    @cached_property
    def pgx_drugs(self) -> DataFrame:
        return self.typed("d_pgx_drugs", schemas.PGX_DRUGS)

    @cached_property
    def pgx_variants(self) -> DataFrame:
        return self.typed("d_pgx_variants", schemas.PGX_VARIANTS)

    @cached_property
    def prs(self) -> DataFrame:
        return self.typed("d_prs", schemas.PRS_WEIGHTS)

    @cached_property
    def gwas(self) -> DataFrame:
        return self.typed("d_gwas", schemas.GWAS)

    @cached_property
    def warning_genes(self) -> DataFrame:
        return self.typed("d_warning_genes", schemas.WARNING_GENES)

    def cohort(self, *genomes: str) -> Cohort:
        return Cohort(
            self.calls, self.annotations, self.genes, self.pgx_drugs, self.pgx_variants, self.prs, self.gwas, self.warning_genes, genomes
        )

    def folder(self) -> str:
        return shared_folder(self.spark)

    def write_lines(self, lines: DataFrame) -> str:
        """Text files in a new shared folder."""
        path = self.folder()
        lines.write.text(path)
        return path


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``; the function takes ``Tables`` and returns a DataFrame."""

    def register(function: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = domain.oracle(oracle)
        return function

    return register
