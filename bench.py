"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The domain tables are first written the way a user keeps them (site tables in chromosome folders, sorted
by position); that step is timed as ``prepare``. Each query then runs to completion once to warm up and is
timed on its second run.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan import schemas
from allelespan.operators import aggregates, filters, joins, layers, ranking
from allelespan.plans import overview, traits, variants
from allelespan.plans.cohort import ALL_GENOMES, Cohort
from allelespan.session import build_session, shared_folder
from allelespan.sources import sinks, tables, vcf
from testbed import texts
from testbed.registry import Tables


def prepare(t: Tables, folder: str) -> Cohort:
    """Write the domain tables and open them again."""
    spark = t.spark

    def stored(name: str, df: DataFrame, schema) -> DataFrame:
        if "pos" in df.columns:
            sinks.write_sites(df, f"{folder}/{name}")
            return tables.read_sites(spark, f"{folder}/{name}", schema)
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    return Cohort(
        stored("calls", t.calls, schemas.CALLS),
        stored("annotations", t.annotations, schemas.ANNOTATIONS),
        stored("genes", t.genes, schemas.GENES),
        stored("pgx_drugs", t.pgx_drugs, schemas.PGX_DRUGS),
        stored("pgx_variants", t.pgx_variants, schemas.PGX_VARIANTS),
        stored("prs", t.prs, schemas.PRS_WEIGHTS),
        stored("gwas", t.gwas, schemas.GWAS),
        stored("warning_genes", t.warning_genes, schemas.WARNING_GENES),
    )


def headline(t: Tables, c: Cohort, folder: str) -> dict:
    """Query name to a function that gives its DataFrame."""
    spark, key = t.spark, schemas.SITE_KEY
    lines = t.view("d_calls").select(
        F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("AN=2;AF_grpmax=0.2;AF=0.1;CLNSIG=Benign"), F.lit("GT"), "gt").alias("value")
    )
    lines.write.text(f"{folder}/lines")
    texts.site_lines(t, texts.EFFECT_INFO).write.text(f"{folder}/effects")
    sinks.write_bucketed(c.calls, "bench_calls", f"{folder}/bucketed_calls", 16)
    sinks.write_bucketed(c.annotations, "bench_annotations", f"{folder}/bucketed_annotations", 16)
    notes = c.annotations
    clinical = notes.filter("clnsig IS NOT NULL").select(*key, *schemas.CLINICAL_COLUMNS)
    frequency = notes.filter("af IS NOT NULL").select(*key, *schemas.FREQUENCY_COLUMNS)
    identifiers = notes.filter("rsid IS NOT NULL").select(*key, "rsid")
    rsids = [f"rs{i}" for i in range(11, 1000, 40)]
    return {
        "scan_vcf_text": lambda: vcf.parse_vcf(vcf.read_vcf_lines(spark, f"{folder}/lines"), ["AF", "CLNSIG"]),
        "scan_snpeff_layer": lambda: vcf.effect_layer(vcf.read_vcf_lines(spark, f"{folder}/effects")),
        "layer_full_build": lambda: layers.build_annotations(notes, clinical, frequency, identifiers),
        "join_annotate": lambda: joins.annotate(c.calls, notes),
        "join_annotate_salted": lambda: joins.annotate(c.calls, notes, salted=True),
        "join_annotate_bucketed": lambda: joins.annotate(spark.table("bench_calls"), spark.table("bench_annotations")),
        "project_variant": lambda: joins.variant_records(joins.annotate(c.calls, notes)),
        "join_gene_interval": lambda: joins.within_intervals(c.calls, joins.padded_genes(c.genes)),
        "filter_smart": lambda: filters.smart(joins.annotate(c.calls, notes), c.pgx_variants),
        "agg_variant_stats": lambda: aggregates.variant_stats(c.calls),
        "agg_prs_score": lambda: traits.calculate_prs(c, trait="t", genome=ALL_GENOMES),
        "agg_pgx_nonref": lambda: aggregates.non_reference_star_alleles(c.pgx_variants, c.calls, [f"BRAND{i}" for i in range(1, 8)]),
        "win_gwas_dedup": lambda: ranking.best_per_rsid(c.gwas, ["study_accession"]),
        "topk_gwas": lambda: traits.query_gwas(c, trait="high"),
        "join_genome_pair": lambda: joins.pair_genomes(c.calls, "g1", "g2"),
        "scan_region": lambda: filters.in_region(c.calls, "chr3", 2000, 500000),
        "query_variants": lambda: variants.query_variants(c, rsids, ALL_GENOMES),
        "query_gene": lambda: variants.query_gene(c, "BRAND2", genome=ALL_GENOMES),
        "query_genes": lambda: variants.query_genes(c, [f"BRAND{i}" for i in range(1, 21)], genome=ALL_GENOMES),
        "query_clinvar": lambda: variants.query_clinvar(c, genome=ALL_GENOMES),
        "query_pgx": lambda: traits.query_pgx(c, drug="nation_3", genome="g1"),
        "genome_summary": lambda: overview.genome_summary(c, genes=("BRAND1", "BRAND2", "BRAND3")),
    }


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("allelespan-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    t, folder = Tables(spark, sf_dir), shared_folder(spark)
    start = time.perf_counter()
    cohort = prepare(t, folder)
    prepared = time.perf_counter() - start
    seconds = {}
    for name, query in headline(t, cohort, folder).items():
        run(query())
        start = time.perf_counter()
        run(query())
        seconds[name] = round(time.perf_counter() - start, 3)
    calls = cohort.calls.count()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "prepare": round(prepared, 3),
                "rows": {"calls": calls, "sites": cohort.annotations.count(), "genomes": cohort.calls.select("genome").distinct().count()},
                "calls_per_sec": {name: round(calls / seconds[name]) for name in ("scan_vcf_text", "join_annotate", "join_gene_interval", "agg_prs_score", "agg_variant_stats")},
            }
        )
    )


if __name__ == "__main__":
    main()
