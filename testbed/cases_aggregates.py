"""Aggregations, per-group choices, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions.contigs import chrom_rank
from allelespan.functions.genotypes import with_genotype
from allelespan.operators import aggregates, filters, joins, layers, packed, ranking, reference_builds
from allelespan.sources import sinks, tables, vcf
from testbed import texts
from testbed.cases_joins import O_STARS, release, _RELEASE
from testbed.cases_sources import _SAMPLES, O_PATHOGENIC, O_SEVERE, cpic, gene_names, phenotypes, variant_summary
from testbed.registry import GENOME_RANK, Tables, query

_KEY = "chrom, pos, ref, alt"
_CALL = "genome, " + _KEY
_CALL_KEY = ["genome", "chrom", "pos", "ref", "alt"]
_SITE_JOIN = "a.chrom = c.chrom AND a.pos = c.pos AND a.ref = c.ref AND a.alt = c.alt"


def annotated(t: Tables) -> DataFrame:
    return joins.annotate(t.calls, t.annotations)


# -- aggregations


@query(
    "agg_variant_stats",
    """SELECT genome, count(*) AS total,
              count(*) FILTER (WHERE length(ref) = 1 AND len(list_filter(string_split(alt, ','), lambda a: length(a) <> 1)) = 0) AS snps,
              count(*) FILTER (WHERE NOT (length(ref) = 1 AND len(list_filter(string_split(alt, ','), lambda a: length(a) <> 1)) = 0)) AS indels,
              count(*) FILTER (WHERE contains(alt, ',')) AS multi_allelic FROM d_calls GROUP BY genome""",
)
def agg_variant_stats(t: Tables) -> DataFrame:
    return aggregates.variant_stats(t.calls)


@query(
    "agg_gwas_traits_for_gene",
    """SELECT trait, mapped_trait, best_pvalue, n_associations FROM (
           SELECT *, row_number() OVER (PARTITION BY upper(trait) ORDER BY p_value NULLS LAST, trait, mapped_trait NULLS FIRST) AS n,
                  p_value AS best_pvalue, count(*) OVER (PARTITION BY upper(trait)) AS n_associations
           FROM d_gwas WHERE contains(mapped_gene, 'BRAND11')) g WHERE n = 1 ORDER BY best_pvalue NULLS LAST, trait LIMIT 20""",
)
def agg_gwas_traits_for_gene(t: Tables) -> DataFrame:
    return aggregates.traits_for_gene(t.gwas, "brand11")


@query(
    "agg_prs_score",
    """SELECT s.genome, s.prs_id, w.trait, round(s.score, 6) AS score, s.found, s.no_call, w.total FROM
           (SELECT genome, prs_id, sum(dosage * weight) AS score, count(*) AS found, count(*) FILTER (WHERE zygosity = 'no_call') AS no_call FROM o_scored GROUP BY genome, prs_id) s
       JOIN (SELECT prs_id, min(trait) AS trait, count(*) AS total FROM d_prs GROUP BY prs_id) w ON s.prs_id = w.prs_id""",
)
def agg_prs_score(t: Tables) -> DataFrame:
    return aggregates.polygenic_scores(joins.score_contributions(t.prs, t.calls), t.prs).withColumn("score", F.round("score", 6))


@query(
    "agg_prs_score_packed",
    f"""WITH first AS (SELECT * FROM ({_SAMPLES}) v QUALIFY row_number() OVER (PARTITION BY genome, chrom, pos ORDER BY ref, alt, gt) = 1),
        listed AS (SELECT *, list_transform(string_split_regex(gt, '[/|]'), lambda x: coalesce(list_concat([ref], string_split(alt, ','))[try_cast(x AS integer) + 1], '?')) AS alleles FROM first),
        scored AS (SELECT genome, prs_id, weight, contains(gt, '.') AS missing, CASE WHEN contains(gt, '.') THEN 0 ELSE len(list_filter(alleles, lambda a: a = effect_allele)) END AS dosage
                   FROM listed JOIN d_prs USING (chrom, pos))
        SELECT s.genome, s.prs_id, w.trait, round(s.score, 6) AS score, s.found, s.no_call, w.total FROM
            (SELECT genome, prs_id, sum(dosage * weight) AS score, count(*) AS found, count(*) FILTER (WHERE missing) AS no_call FROM scored GROUP BY genome, prs_id) s
        JOIN (SELECT prs_id, min(trait) AS trait, count(*) AS total FROM d_prs GROUP BY prs_id) w ON s.prs_id = w.prs_id""",
)
def agg_prs_score_packed(t: Tables) -> DataFrame:
    """Scores from a table with one row per site, for the samples of the three-sample files."""
    lines, path = vcf.read_vcf_lines(t.spark, texts.sample_files(t)), t.folder()
    sinks.write_sites(vcf.parse_packed(lines), path)
    scores = packed.packed_scores(t.prs, tables.read_sites(t.spark, path), vcf.sample_names(lines))
    return scores.withColumn("score", F.round("score", 6))


@query(
    "agg_pathogenic_summary",
    "SELECT genome, count(*) AS calls, count(DISTINCT gene) AS genes FROM o_annotated WHERE contains(lower(clnsig), 'athogenic') GROUP BY genome",
)
def agg_pathogenic_summary(t: Tables) -> DataFrame:
    return aggregates.significance_summary(annotated(t))


_QUICK = [f"BRAND{i}" for i in range(1, 8)]


@query(
    "agg_pgx_nonref",
    """SELECT c.genome, v.gene, count(*) AS non_reference FROM d_pgx_variants v JOIN o_first_calls c ON v.chrom = c.chrom AND v.pos = c.pos
       WHERE v.gene IN ('BRAND1', 'BRAND2', 'BRAND3', 'BRAND4', 'BRAND5', 'BRAND6', 'BRAND7') AND c.zygosity <> 'homozygous_ref' GROUP BY c.genome, v.gene""",
)
def agg_pgx_nonref(t: Tables) -> DataFrame:
    return aggregates.non_reference_star_alleles(t.pgx_variants, t.calls, _QUICK)


@query(
    "agg_clinvar_by_gene",
    "SELECT genome, coalesce(gene, 'Unknown') AS gene, count(*) AS variants FROM o_annotated WHERE contains(lower(clnsig), 'benign') GROUP BY genome, coalesce(gene, 'Unknown')",
)
def agg_clinvar_by_gene(t: Tables) -> DataFrame:
    return aggregates.counts_by_gene(joins.calls_with_significance(t.calls, t.annotations, "benign"))


@query("agg_rsid_coverage", "SELECT count(*) AS total, count(rsid) AS has_rsid, count(*) > 0 AND count(rsid) > count(*) * 0.9 AS skip_backfill FROM d_annotations")
def agg_rsid_coverage(t: Tables) -> DataFrame:
    return aggregates.rsid_coverage(t.annotations)


@query("agg_distinct_traits", "SELECT DISTINCT prs_id, trait FROM d_prs")
def agg_distinct_traits(t: Tables) -> DataFrame:
    return aggregates.distinct_traits(t.prs)


@query("agg_has_af", "SELECT genome, bool_or(af IS NOT NULL) AS has_af FROM o_annotated GROUP BY genome")
def agg_has_af(t: Tables) -> DataFrame:
    return aggregates.frequency_known(annotated(t))


@query("agg_suppressed", "SELECT genome, count(*) AS variants, count(*) FILTER (WHERE suppressed) AS suppressed FROM o_smart GROUP BY genome")
def agg_suppressed(t: Tables) -> DataFrame:
    return aggregates.suppressed_counts(filters.mark_suppressed(annotated(t), t.pgx_variants))


@query(
    "agg_update_counts",
    f"""SELECT 'clinvar' AS layer, count(*) AS updated FROM ({_RELEASE}) c JOIN d_annotations a ON {_SITE_JOIN}
        UNION ALL SELECT 'gnomad', count(*) FROM d_sites WHERE af IS NOT NULL
        UNION ALL SELECT 'dbsnp', count(*) FROM d_sites WHERE vcf_id IS NULL AND dbsnp_id IS NOT NULL""",
)
def agg_update_counts(t: Tables) -> DataFrame:
    base = t.sites.select("chrom", "pos", "ref", "alt", F.col("vcf_id").alias("rsid"))
    return aggregates.update_counts(base, {"clinvar": release(t), "gnomad": t.sites.filter("af IS NOT NULL"), "dbsnp": t.sites.filter("dbsnp_id IS NOT NULL")})


@query("agg_ingest_quality", "SELECT (SELECT count(*) FROM d_gwas) AS loaded, (SELECT count(*) FROM customer) AS skipped")
def agg_ingest_quality(t: Tables) -> DataFrame:
    return aggregates.ingest_quality(tables.read_gwas_rows(t.spark, t.write_lines(texts.gwas_lines(t))))


@query("agg_collect_star_alleles", O_STARS)
def agg_collect_star_alleles(t: Tables) -> DataFrame:
    return reference_builds.star_alleles_by_rsid(cpic(t))


@query("agg_genes_in_result", "SELECT DISTINCT genome, gene FROM o_annotated WHERE gene IS NOT NULL AND clnsig = 'drug_response'")
def agg_genes_in_result(t: Tables) -> DataFrame:
    return aggregates.genes_in_result(joins.calls_with_significance(t.calls, t.annotations, "drug_response"))


_COVERAGE = """SELECT genome, count(*) AS calls, count(gene) AS snpeff, count(clnsig) AS clinvar, count(coalesce(af, af_grpmax)) AS gnomad, count(rsid) AS dbsnp FROM o_annotated GROUP BY genome"""


@query(
    "agg_layer_coverage",
    f"""SELECT genome, calls, layer, annotated, round(annotated / calls, 4) AS share
        FROM (UNPIVOT ({_COVERAGE}) ON snpeff, clinvar, gnomad, dbsnp INTO NAME layer VALUE annotated) u""",
)
def agg_layer_coverage(t: Tables) -> DataFrame:
    return aggregates.layer_coverage(annotated(t))


@query(
    "agg_contig_style",
    "SELECT genome, bool_or(starts_with(contig, 'chr')) AS uses_chr, min(CASE WHEN contig IN ('chrM', 'chrMT', 'M', 'MT') THEN contig END) AS mito_name FROM d_calls GROUP BY genome",
)
def agg_contig_style(t: Tables) -> DataFrame:
    return aggregates.contig_styles(t.view("d_calls"))


@query(
    "agg_table_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM d_{n}" for n in ("genes", "pgx_drugs", "pgx_variants", "prs", "gwas", "warning_genes")),
)
def agg_table_counts(t: Tables) -> DataFrame:
    return aggregates.table_counts(
        {"genes": t.genes, "pgx_drugs": t.pgx_drugs, "pgx_variants": t.pgx_variants, "prs": t.prs, "gwas": t.gwas, "warning_genes": t.warning_genes}
    )


# -- per-group choices


@query(
    "win_gwas_dedup",
    """SELECT rsid, trait, p_value, k FROM d_gwas WHERE rsid IS NULL UNION ALL
       SELECT rsid, trait, p_value, k FROM (SELECT *, row_number() OVER (PARTITION BY rsid ORDER BY p_value NULLS LAST, k) AS n FROM d_gwas WHERE rsid IS NOT NULL) d WHERE n = 1""",
)
def win_gwas_dedup(t: Tables) -> DataFrame:
    return ranking.best_per_rsid(t.view("d_gwas").select("rsid", "trait", "p_value", "k"), ["k"])


@query(
    "win_top_n_per_gene",
    f"""SELECT g.symbol, c.genome, c.chrom, c.pos, c.ref, c.alt FROM d_calls c JOIN o_padded g ON c.chrom = g.chrom AND c.pos BETWEEN g.start_pos AND g.end_pos
        QUALIFY row_number() OVER (PARTITION BY c.genome, g.symbol ORDER BY {GENOME_RANK.format('c.chrom')}, c.pos, c.ref, c.alt) <= 3""",
)
def win_top_n_per_gene(t: Tables) -> DataFrame:
    pairs = joins.within_intervals(t.calls, joins.padded_genes(t.genes))
    return ranking.top_per_gene(pairs, 3).select("symbol", *_CALL_KEY)


# calls with a second record at the same place, as split multi-allelic files have them
_SPLIT = f"SELECT {_CALL}, gt FROM d_calls UNION ALL SELECT genome, chrom, pos, ref, alt || 'C', '0/1' FROM d_calls WHERE ref = 'A'"


@query("win_first_call_at_site", f"SELECT * FROM ({_SPLIT}) c QUALIFY row_number() OVER (PARTITION BY genome, chrom, pos ORDER BY ref, alt, gt) = 1")
def win_first_call_at_site(t: Tables) -> DataFrame:
    return joins.first_calls(t.sql(_SPLIT).withColumn("pos", F.col("pos").cast("bigint")))


@query(
    "win_top_n_weights",
    "SELECT prs_id, trait, rsid, chrom, pos, effect_allele, weight FROM d_prs QUALIFY row_number() OVER (PARTITION BY prs_id ORDER BY abs(weight) DESC, chrom, pos, rsid) <= 100",
)
def win_top_n_weights(t: Tables) -> DataFrame:
    return ranking.top_weights(t.prs, 100)


@query(
    "win_top_n_weights_large",
    "SELECT prs_id, trait, rsid, chrom, pos, effect_allele, weight FROM d_prs QUALIFY row_number() OVER (PARTITION BY prs_id ORDER BY abs(weight) DESC, chrom, pos, rsid) <= 2500",
)
def win_top_n_weights_large(t: Tables) -> DataFrame:
    return ranking.top_weights(t.prs, 2500)


_STARS_TWICE = "SELECT gene, rsid, chrom, pos, ref, alt, star_allele, function_impact FROM d_pgx_variants UNION ALL SELECT gene, rsid, chrom, pos + 1, ref, alt, star_allele, 'later' FROM d_pgx_variants"


@query("win_dedup_star_alleles", "SELECT gene, rsid, chrom, pos, ref, alt, star_allele, function_impact FROM d_pgx_variants QUALIFY row_number() OVER (PARTITION BY gene, rsid, star_allele ORDER BY pos, ref, alt, function_impact NULLS LAST) = 1")
def win_dedup_star_alleles(t: Tables) -> DataFrame:
    return ranking.one_star_allele(t.sql(_STARS_TWICE).withColumn("pos", F.col("pos").cast("bigint")))


# one layer row per order line: many copies of a site, of which the earliest line counts
_COPIES = "SELECT chrom, pos, ref, alt, 'rs' || cast(l_orderkey AS string) AS rsid, l_orderkey AS o, l_linenumber AS n FROM lineitem JOIN d_sites ON l_partkey = k"


@query("win_layer_dedup", f"SELECT * FROM ({_COPIES}) c QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY o, n) = 1")
def win_layer_dedup(t: Tables) -> DataFrame:
    rows = t.sql(_COPIES).withColumn("pos", F.col("pos").cast("bigint"))
    return layers.one_row_per_site(rows, ["o", "n"])


@query(
    "win_cap_truncated",
    f"""SELECT {_CALL}, total > 500 AS truncated FROM (
            SELECT *, count(*) OVER (PARTITION BY genome) AS total, row_number() OVER (PARTITION BY genome ORDER BY {GENOME_RANK.format('chrom')}, pos, ref, alt) AS n FROM d_calls) c WHERE n <= 500""",
)
def win_cap_truncated(t: Tables) -> DataFrame:
    return ranking.capped(t.calls.select(*_CALL_KEY), 500)


# -- sorts and top rows


@query(
    "topk_gwas",
    """SELECT rsid, trait, p_value, k, cast(row_number() OVER (ORDER BY p_value NULLS LAST, k) AS int) AS rank, count(*) OVER () > 30 AS truncated
       FROM (SELECT * FROM d_gwas WHERE contains(lower(trait), 'high') QUALIFY rsid IS NULL OR row_number() OVER (PARTITION BY rsid ORDER BY p_value NULLS LAST, k) = 1) d
       QUALIFY row_number() OVER (ORDER BY p_value NULLS LAST, k) <= 30""",
)
def topk_gwas(t: Tables) -> DataFrame:
    found = filters.associations_matching(t.view("d_gwas"), trait="HIGH")
    return ranking.top_associations(found.select("rsid", "trait", "p_value", "k"), ["k"], 30)


@query(
    "topk_prs_contributions",
    """SELECT genome, prs_id, rsid, cast(dosage AS bigint) AS dosage, round(dosage * weight, 6) AS contribution, cast(n AS int) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY genome, prs_id ORDER BY abs(dosage * weight) DESC, chrom, pos, rsid, effect_allele) AS n FROM o_scored WHERE dosage * weight <> 0) c WHERE n <= 15""",
)
def topk_prs_contributions(t: Tables) -> DataFrame:
    rows = ranking.top_contributions(joins.score_contributions(t.prs, t.calls))
    return rows.select("genome", "prs_id", "rsid", "dosage", F.round("contribution", 6).alias("contribution"), "rank")


@query(
    "sort_genome_order",
    f"""SELECT symbol, chrom, start_pos, end_pos, row_number() OVER (ORDER BY {GENOME_RANK.format('chrom')}, start_pos, symbol) AS place FROM d_genes""",
)
def sort_genome_order(t: Tables) -> DataFrame:
    """Global order, proved by each row's place in the sorted part files."""
    genes = t.genes.select("symbol", "chrom", "start_pos", "end_pos")
    return ranking.numbered(genes, [chrom_rank(F.col("chrom")), "start_pos", "symbol"])


@query(
    "sort_pgx",
    """SELECT gene, rsid, star_allele, chrom, pos, function_impact, row_number() OVER (
           ORDER BY gene NULLS FIRST, rsid NULLS FIRST, star_allele NULLS FIRST, chrom NULLS FIRST, pos NULLS FIRST, ref, alt) AS place FROM d_pgx_variants""",
)
def sort_pgx(t: Tables) -> DataFrame:
    return ranking.numbered(t.pgx_variants, ranking.star_allele_order()).select("gene", "rsid", "star_allele", "chrom", "pos", "function_impact", "place")


@query(
    "limit_results",
    f"""SELECT {_CALL}, display FROM o_calls WHERE zygosity <> 'homozygous_ref' ORDER BY {GENOME_RANK.format('chrom')}, pos, ref, alt, genome LIMIT 50""",
)
def limit_results(t: Tables) -> DataFrame:
    rows = filters.non_reference(with_genotype(t.calls)).select(*_CALL_KEY, F.col("genotype.display").alias("display"))
    return ranking.first_rows(rows, 50, [*ranking.genome_order(), "genome"])


# -- set operations


@query(
    "set_warning_genes",
    f"SELECT symbol FROM ({O_PATHOGENIC}) p WHERE symbol IN (SELECT symbol FROM ({O_SEVERE}) s) AND symbol NOT IN (SELECT gene FROM d_pgx_drugs WHERE cpic_level = 'B')",
)
def set_warning_genes(t: Tables) -> DataFrame:
    actionable = t.pgx_drugs.filter("cpic_level = 'B'").select(F.col("gene").alias("symbol"))
    return reference_builds.warning_gene_list(
        tables.pathogenic_genes(variant_summary(t)), tables.severe_phenotype_genes(phenotypes(t)), actionable
    )


@query(
    "set_union_gene_lists",
    "SELECT symbol, cast(min(list) AS int) AS list FROM (SELECT s_name AS symbol, 1 AS list FROM supplier WHERE s_nationkey % 5 <> 0 UNION ALL SELECT s_name, 2 FROM supplier WHERE s_acctbal > 0) u GROUP BY symbol",
)
def set_union_gene_lists(t: Tables) -> DataFrame:
    return reference_builds.union_gene_lists(gene_names(t), t.sql("SELECT s_name AS symbol FROM supplier WHERE s_acctbal > 0"))


@query("set_concat_chromosomes", f"SELECT {_CALL} FROM d_calls")
def set_concat_chromosomes(t: Tables) -> DataFrame:
    from allelespan.sources import sinks

    # written as one folder per chromosome group, read back as one table
    folder = t.folder()
    autosome = F.col("chrom").cast("string").rlike("^[0-9]+$")
    sinks.write_sites(t.calls.filter(autosome), f"{folder}/autosomes")
    sinks.write_sites(t.calls.filter(~autosome), f"{folder}/others")
    parts = [tables.read_sites(t.spark, f"{folder}/{name}") for name in ("autosomes", "others")]
    return reference_builds.union_all(parts).select(*_CALL_KEY)


@query("set_union_scores", "SELECT prs_id, trait, rsid, weight FROM d_prs")
def set_union_scores(t: Tables) -> DataFrame:
    names = sorted(row.prs_id for row in t.prs.select("prs_id").distinct().collect())  # one row a score
    parts = [t.prs.filter(F.col("prs_id") == name) for name in names]
    return reference_builds.union_all(parts).select("prs_id", "trait", "rsid", "weight")
