"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions import contigs
from allelespan.functions.genotypes import with_genotype
from allelespan.operators import aggregates, filters, joins
from allelespan.sources import sinks
from testbed.registry import Tables, query

_KEY = "chrom, pos, ref, alt"
_NOTE = f"{_KEY}, rsid, gene, effect, impact, clnsig, af"
_NOTE_COLUMNS = ["chrom", "pos", "ref", "alt", "rsid", "gene", "effect", "impact", "clnsig", "af"]
_CALL_KEY = ["genome", "chrom", "pos", "ref", "alt"]
_CALL = "genome, " + _KEY


@query("filter_region", f"SELECT {_NOTE} FROM d_annotations WHERE chrom = 'MT' AND pos BETWEEN 1888 AND 600000")
def filter_region(t: Tables) -> DataFrame:
    return filters.in_region(t.annotations, "chrM", 1888, 600000).select(*_NOTE_COLUMNS)


@query("filter_site", f"SELECT {_NOTE} FROM d_annotations WHERE chrom = 'X' AND pos = 1814 AND ref = 'G' AND alt = 'T'")
def filter_site(t: Tables) -> DataFrame:
    return filters.at_site(t.annotations, "chrX", 1814, "G", "T").select(*_NOTE_COLUMNS)


@query("filter_genome", f"SELECT {_CALL}, gt FROM d_calls WHERE genome = 'g3'")
def filter_genome(t: Tables) -> DataFrame:
    return t.cohort("g3", "g5").calls_of("g3").select(*_CALL_KEY, "gt")


@query("filter_genome_layout", f"SELECT {_CALL}, gt FROM d_calls WHERE genome IN ('g3', 'g5')")
def filter_genome_layout(t: Tables) -> DataFrame:
    """The same on calls kept in the genome layout."""
    path = t.folder()
    sinks.write_genomes(t.calls, path)
    return filters.of_genomes(t.spark.read.parquet(path), "g3", "g5").select(*_CALL_KEY, "gt")


@query("filter_rsid", f"SELECT {_NOTE} FROM d_annotations WHERE rsid IN ('rs50', 'rs7', 'rs150')")
def filter_rsid(t: Tables) -> DataFrame:
    return filters.with_rsids(t.annotations, ["rs50", "rs7", "rs150"]).select(*_NOTE_COLUMNS)


_IDS = "CASE k % 3 WHEN 0 THEN rsid WHEN 1 THEN 'kgp' || cast(k AS string) ELSE rsid || 'x' END"


@query("filter_valid_ids", "SELECT rsid AS given, k FROM d_gwas WHERE rsid IS NOT NULL AND k % 3 = 0")
def filter_valid_ids(t: Tables) -> DataFrame:
    return filters.valid_rsids(t.sql(f"SELECT {_IDS} AS given, k FROM d_gwas"), "given")


@query("filter_clinvar", f"SELECT {_NOTE} FROM d_annotations WHERE contains(lower(clnsig), 'pathogenic')")
def filter_clinvar(t: Tables) -> DataFrame:
    return filters.with_significance(t.annotations, "PATHOGENIC").select(*_NOTE_COLUMNS)


@query("filter_clinvar_region", f"SELECT {_NOTE} FROM d_annotations WHERE contains(lower(clnsig), 'benign') AND chrom = '5' AND pos BETWEEN 1 AND 300000")
def filter_clinvar_region(t: Tables) -> DataFrame:
    return filters.with_significance(filters.in_region(t.annotations, "chr5", 1, 300000), "benign").select(*_NOTE_COLUMNS)


@query("filter_condition", f"SELECT {_NOTE}, clndn FROM d_annotations WHERE clndn <> '.' AND contains(upper(replace(clndn, '_', ' ')), 'RED W')")
def filter_condition(t: Tables) -> DataFrame:
    return filters.with_condition(t.annotations, "red w").select(*_NOTE_COLUMNS, "clndn")


@query("filter_impact", f"SELECT {_NOTE} FROM d_annotations WHERE impact IS NULL OR impact IN ('HIGH', 'LOW')")
def filter_impact(t: Tables) -> DataFrame:
    return filters.with_impact(t.annotations, "high, LOW").select(*_NOTE_COLUMNS)


@query("filter_quality", f"SELECT {_NOTE} FROM d_annotations WHERE impact IS NOT NULL OR clnsig IS NOT NULL OR rsid IS NOT NULL")
def filter_quality(t: Tables) -> DataFrame:
    return filters.informative(t.annotations).select(*_NOTE_COLUMNS)


@query("filter_smart", f"SELECT {_CALL}, rsid, gene, impact, clnsig, af FROM o_smart WHERE NOT suppressed")
def filter_smart(t: Tables) -> DataFrame:
    rows = joins.annotate(t.calls, t.annotations)
    return filters.smart(rows, t.pgx_variants).select(*_CALL_KEY, "rsid", "gene", "impact", "clnsig", "af")


@query(
    "filter_text",
    f"""SELECT {_NOTE} FROM d_annotations WHERE gene IS NOT NULL AND (contains(impact, 'P.ALA1') OR contains(upper(effect), 'P.ALA1')
        OR contains(gene, 'P.ALA1') OR contains(transcript, 'P.ALA1') OR contains(upper(hgvs_c), 'P.ALA1') OR contains(upper(hgvs_p), 'P.ALA1'))""",
)
def filter_text(t: Tables) -> DataFrame:
    return filters.with_text(t.annotations, 'ANN ~"p.ala1"').select(*_NOTE_COLUMNS)


@query("filter_nonref", f"SELECT {_CALL}, display, zygosity FROM o_calls WHERE zygosity <> 'homozygous_ref'")
def filter_nonref(t: Tables) -> DataFrame:
    rows = filters.non_reference(with_genotype(t.calls))
    return rows.select(*_CALL_KEY, "genotype.display", "genotype.zygosity")


@query("filter_ci_equals", "SELECT drug_name, gene, cpic_level FROM d_pgx_drugs WHERE lower(drug_name) = 'nation_7'")
def filter_ci_equals(t: Tables) -> DataFrame:
    return filters.equals_ignoring_case(t.pgx_drugs, "drug_name", "Nation_7").select("drug_name", "gene", "cpic_level")


@query("filter_ci_contains", "SELECT rsid, trait, mapped_trait, k FROM d_gwas WHERE contains(lower(trait), 'not spec')")
def filter_ci_contains(t: Tables) -> DataFrame:
    return t.view("d_gwas").filter(filters.contains_ignoring_case("trait", "Not Spec")).select("rsid", "trait", "mapped_trait", "k")


@query(
    "filter_gwas",
    """SELECT rsid, trait, mapped_trait, mapped_gene, p_value, k FROM d_gwas
       WHERE (contains(lower(trait), 'status f') OR contains(lower(mapped_trait), 'status f')) AND contains(mapped_gene, 'BRAND7')""",
)
def filter_gwas(t: Tables) -> DataFrame:
    rows = filters.associations_matching(t.view("d_gwas"), trait="Status F", gene="brand7")
    return rows.select("rsid", "trait", "mapped_trait", "mapped_gene", "p_value", "k")


@query("filter_rsid_missing", f"SELECT {_NOTE} FROM d_annotations WHERE rsid IS NULL")
def filter_rsid_missing(t: Tables) -> DataFrame:
    return filters.without_rsid(t.annotations).select(*_NOTE_COLUMNS)


_CONTIGS = "CASE k % 6 WHEN 0 THEN chrom WHEN 1 THEN 'chr' || chrom WHEN 2 THEN 'KI27' || cast(k AS string) WHEN 3 THEN 'chrUn' WHEN 4 THEN 'chrM' ELSE '23' END"


@query(
    "filter_standard_chrom",
    """SELECT k, CASE k % 6 WHEN 0 THEN chrom WHEN 1 THEN 'chr' || chrom WHEN 4 THEN 'chrM' ELSE '23' END AS contig,
              k % 6 IN (0, 5) AS for_scores, CASE WHEN k % 6 = 0 THEN 'chr' || chrom END AS for_gwas
       FROM d_sites WHERE k % 6 NOT IN (2, 3)""",
)
def filter_standard_chrom(t: Tables) -> DataFrame:
    contig = F.col("contig")
    rows = t.sql(f"SELECT k, {_CONTIGS} AS contig FROM d_sites").filter(contigs.is_catalog_chrom(contig))
    return rows.select("k", "contig", contigs.is_score_chrom(contig).alias("for_scores"), contigs.gwas_chrom(contig).alias("for_gwas"))


@query(
    "project_variant",
    f"""SELECT {_CALL}, rsid, display, zygosity, gene, effect, impact, transcript, hgvs_c, hgvs_p,
               replace(clnsig, '_', ' ') AS significance, CASE WHEN clndn <> '.' THEN replace(clndn, '_', ' ') END AS condition,
               CASE WHEN clnrevstat <> '.' THEN replace(clnrevstat, '_', ' ') END AS review_status, af AS "global", af_grpmax AS popmax
        FROM o_annotated""",
)
def project_variant(t: Tables) -> DataFrame:
    return joins.flatten_records(joins.variant_records(joins.annotate(t.calls, t.annotations)))


@query("count_valid_ids", "SELECT count(*) FILTER (WHERE rsid IS NOT NULL AND k % 3 = 0) AS valid, count(*) FILTER (WHERE rsid IS NULL OR k % 3 <> 0) AS invalid FROM d_gwas")
def count_valid_ids(t: Tables) -> DataFrame:
    return aggregates.valid_id_counts(t.sql(f"SELECT {_IDS} AS given FROM d_gwas"), "given")
