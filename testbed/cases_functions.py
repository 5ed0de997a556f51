"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelespan.functions import associations, clinical, contigs, genotypes, numbers, vcf_fields
from allelespan.operators import aggregates, reference_builds
from testbed.cases_sources import CPIC_SOURCES
from testbed.registry import Tables, query


@query("fn_normalize_chrom", "SELECT genome, k, chrom FROM d_calls")
def fn_normalize_chrom(t: Tables) -> DataFrame:
    return t.view("d_calls").select("genome", "k", contigs.normalize_chrom(F.col("contig")).alias("chrom"))


@query("fn_contig_rename", "SELECT k, chrom AS contig FROM d_sites UNION ALL SELECT s_suppkey, 'NT_' || cast(s_suppkey AS string) FROM supplier")
def fn_contig_rename(t: Tables) -> DataFrame:
    names = contigs.accession_table(t.spark)
    known = t.sites.select("k", "chrom").join(names.withColumnRenamed("new_name", "chrom"), "chrom").select("k", "contig")
    other = t.sql("SELECT s_suppkey AS k, 'NT_' || cast(s_suppkey AS string) AS contig FROM supplier")
    return contigs.rename_contigs(known.unionByName(other), "contig", names)


@query("fn_contig_style", "SELECT genome, k, contig FROM d_calls")
def fn_contig_style(t: Tables) -> DataFrame:
    """Bare names rendered back in each genome's own spelling, learnt from its records."""
    raw = t.view("d_calls")
    styles = aggregates.contig_styles(raw)
    spelled = contigs.contig_in_style(F.col("chrom"), F.col("uses_chr"), F.col("mito_name"))
    return raw.select("genome", "k", "chrom").join(styles, "genome").select("genome", "k", spelled.alias("contig"))


_INFO = "CASE WHEN k % 5 = 0 THEN '' ELSE 'AF_grpmax=9;' END || CASE WHEN af IS NULL THEN 'XAF=7' WHEN k % 7 = 0 THEN 'AF=' ELSE 'AF=' || cast(af AS string) END || CASE WHEN k % 2 = 0 THEN ';DB' ELSE ';AF=8;DP=5' END"


@query(
    "fn_info_field",
    """SELECT k, CASE WHEN af IS NULL THEN CASE WHEN k % 2 = 0 THEN NULL ELSE '8' END WHEN k % 7 = 0 THEN '' ELSE cast(af AS string) END AS af,
              CASE WHEN k % 2 = 1 THEN '5' END AS dp FROM d_sites""",
)
def fn_info_field(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT k, {_INFO} AS info FROM d_sites")
    return rows.select("k", vcf_fields.info_field(F.col("info"), "AF").alias("af"), vcf_fields.info_field(F.col("info"), "DP").alias("dp"))


_ANN = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN 'A|x|HIGH|G' ELSE 'A|' || coalesce(effect, '') || '|LOW|' || brand || '|4|5|' || cast(k AS string) || '|7|8|c.1|p.1,second|entry' END"


@query(
    "fn_parse_ann",
    """SELECT k, CASE WHEN k % 6 > 2 THEN brand END AS gene, CASE WHEN k % 6 > 2 THEN coalesce(effect, '') END AS effect, CASE WHEN k % 6 > 2 THEN 'LOW' END AS impact,
              CASE WHEN k % 6 > 2 THEN cast(k AS string) END AS transcript, CASE WHEN k % 6 > 2 THEN 'c.1' END AS hgvs_c, CASE WHEN k % 6 > 2 THEN 'p.1' END AS hgvs_p FROM d_sites""",
)
def fn_parse_ann(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT k, {_ANN} AS ann FROM d_sites").withColumn("e", vcf_fields.effect_fields(F.col("ann")))
    return rows.select("k", "e.*")


@query(
    "fn_parse_af",
    "SELECT k, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN af_grpmax WHEN 2 THEN coalesce(af_grpmax, 0.25) WHEN 3 THEN NULL WHEN 4 THEN 0.00001 ELSE coalesce(af_grpmax, 0.5) END AS af FROM d_sites",
)
def fn_parse_af(t: Tables) -> DataFrame:
    text = "coalesce(cast(af_grpmax AS string), '.')"
    raw = f"CASE k % 6 WHEN 0 THEN '.,.' WHEN 1 THEN {text} WHEN 2 THEN {text} || ',0.25' WHEN 3 THEN 'n/a, ,' WHEN 4 THEN ' 1e-05 ' ELSE 'x, ' || {text} || ', 0.5' END"
    return t.sql(f"SELECT k, {raw} AS raw FROM d_sites").select("k", vcf_fields.first_frequency(F.col("raw")).alias("af"))


@query("fn_parse_genotype", "SELECT genome, k, display, zygosity FROM o_calls")
def fn_parse_genotype(t: Tables) -> DataFrame:
    return genotypes.with_genotype(t.view("d_calls")).select("genome", "k", "genotype.*")


@query(
    "fn_zygosity_short",
    "SELECT genome, k, CASE zygosity WHEN 'homozygous_ref' THEN 'ref' WHEN 'heterozygous' THEN 'het' WHEN 'homozygous_alt' THEN 'hom alt' ELSE 'no call' END AS label FROM o_calls",
)
def fn_zygosity_short(t: Tables) -> DataFrame:
    zygosity = genotypes.zygosity_of(genotypes.called_alleles(F.col("gt"), F.col("ref"), F.col("alt")), F.col("ref"))
    return t.view("d_calls").select("genome", "k", genotypes.zygosity_label(zygosity).alias("label"))


@query(
    "fn_clinvar_fields",
    """SELECT k, replace(clnsig, '_', ' ') AS significance, CASE WHEN clndn <> '.' THEN replace(clndn, '_', ' ') END AS condition,
              CASE WHEN clnrevstat <> '.' THEN replace(clnrevstat, '_', ' ') END AS review_status FROM d_sites""",
)
def fn_clinvar_fields(t: Tables) -> DataFrame:
    fields = clinical.clinical_struct(F.col("clnsig"), F.col("clndn"), F.col("clnrevstat"))
    return t.sites.select("k", fields.alias("c")).select("k", "c.*")


@query("fn_dosage", "SELECT genome, prs_id, rsid, cast(dosage AS bigint) AS dosage FROM o_scored")
def fn_dosage(t: Tables) -> DataFrame:
    alleles = genotypes.called_alleles(F.col("gt"), F.col("ref"), F.col("alt"))
    scored = t.calls.join(t.prs.select("prs_id", F.col("rsid").alias("weight_rsid"), "chrom", "pos", "effect_allele"), ["chrom", "pos"])
    return scored.select("genome", "prs_id", F.col("weight_rsid").alias("rsid"), genotypes.dosage(alleles, F.col("effect_allele")).alias("dosage"))


@query(
    "fn_sig_terms",
    """SELECT k, array_to_string(list_filter(list_transform(string_split_regex(lower(replace(clnsig, '_', ' ') || ', Other /'), '[/,]'), lambda x: trim(x)), lambda x: x <> ''), '+') AS terms
       FROM d_sites WHERE clnsig IS NOT NULL UNION ALL SELECT k, '' FROM d_sites WHERE clnsig IS NULL""",
)
def fn_sig_terms(t: Tables) -> DataFrame:
    raw = F.concat(clinical.spaced(F.col("clnsig")), F.lit(", Other /"))
    return t.sites.select("k", F.array_join(clinical.significance_terms(raw), "+").alias("terms"))


@query(
    "fn_variant_class",
    """SELECT genome, k, CASE WHEN length(ref) = 1 AND len(list_filter(string_split(alt, ','), lambda a: length(a) <> 1)) = 0 THEN 'SNP' ELSE 'Indel' END AS class,
              cast(len(string_split(alt, ',')) AS int) AS alts FROM d_calls""",
)
def fn_variant_class(t: Tables) -> DataFrame:
    ref, alt = F.col("ref"), F.col("alt")
    return t.view("d_calls").select("genome", "k", genotypes.variant_class(ref, alt).alias("class"), genotypes.alt_count(alt).alias("alts"))


_SNPS = "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN rsid || '-A' WHEN 2 THEN 'kgp1;' || rsid WHEN 3 THEN rsid || '; rs5' WHEN 4 THEN 'rsABC' WHEN 5 THEN rsid || 'x; ' || rsid || '-?' ELSE 'chr1:5; ' || rsid || ' ' END"


@query("fn_gwas_rsid", "SELECT k, CASE WHEN k % 7 NOT IN (0, 4) THEN rsid END AS parsed FROM d_gwas")
def fn_gwas_rsid(t: Tables) -> DataFrame:
    return t.sql(f"SELECT k, {_SNPS} AS snps FROM d_gwas").select("k", associations.gwas_rsid(F.col("snps")).alias("parsed"))


_RISK = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'rs1' WHEN 2 THEN 'rs1-?' WHEN 3 THEN 'rs1-ACGTACGTACG' WHEN 4 THEN 'rs1- ' || coalesce(risk_allele, ' ') ELSE 'rs1-' || coalesce(risk_allele, 'T') || '-x' END"


@query("fn_risk_allele", "SELECT k, CASE k % 6 WHEN 4 THEN risk_allele WHEN 5 THEN coalesce(risk_allele, 'T') || '-x' END AS allele FROM d_gwas")
def fn_risk_allele(t: Tables) -> DataFrame:
    return t.sql(f"SELECT k, {_RISK} AS raw FROM d_gwas").select("k", associations.risk_allele(F.col("raw")).alias("allele"))


_NUMBER = "CASE k % 7 WHEN 0 THEN 'NR' WHEN 1 THEN 'NS' WHEN 2 THEN '' WHEN 3 THEN 'about 3' WHEN 4 THEN '7d' WHEN 5 THEN '3E-8' ELSE cast(or_beta AS string) END"


@query(
    "fn_safe_numeric",
    "SELECT k, CASE k % 7 WHEN 5 THEN 3e-8 WHEN 6 THEN or_beta END AS number, CASE k % 3 WHEN 0 THEN pos END AS whole FROM d_gwas",
)
def fn_safe_numeric(t: Tables) -> DataFrame:
    whole = "CASE k % 3 WHEN 0 THEN cast(pos AS string) WHEN 1 THEN '1.5' ELSE 'x' END"
    rows = t.sql(f"SELECT k, {_NUMBER} AS a, {whole} AS b FROM d_gwas")
    return rows.select("k", numbers.to_double(F.col("a")).alias("number"), numbers.to_long(F.col("b")).alias("whole"))


@query("fn_gwas_chrom", "SELECT k, CASE k % 4 WHEN 0 THEN 'chr' || chrom WHEN 1 THEN 'chr' || chrom END AS chrom FROM d_gwas")
def fn_gwas_chrom(t: Tables) -> DataFrame:
    raw = "CASE k % 4 WHEN 0 THEN chrom WHEN 1 THEN ' ' || chrom || ' ' WHEN 2 THEN '23' ELSE '' END"
    return t.sql(f"SELECT k, {raw} AS raw FROM d_gwas").select("k", contigs.gwas_chrom(F.col("raw")).alias("chrom"))


@query(
    "fn_hgvs_alleles",
    f"SELECT id, CASE (id - 1) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'AC' END AS ref, CASE (id - 1) % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'del' WHEN 2 THEN 'del' END AS alt FROM ({CPIC_SOURCES['sequence_location']}) l",
)
def fn_hgvs_alleles(t: Tables) -> DataFrame:
    rows = t.sql(CPIC_SOURCES["sequence_location"])
    return rows.select("id", associations.hgvs_alleles(F.col("chromosomelocation")).alias("a")).select("id", "a.ref", "a.alt")


@query("fn_parse_region", "SELECT symbol, chrom, start_pos, end_pos FROM d_genes")
def fn_parse_region(t: Tables) -> DataFrame:
    text = F.concat(contigs.chr_name(F.col("chrom")), F.lit(":"), F.col("start_pos"), F.lit("-"), F.col("end_pos"))
    return t.genes.select("symbol", contigs.region_parts(text).alias("r")).select("symbol", "r.*")


@query("fn_clean_description", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name || CASE WHEN s_suppkey % 5 = 1 THEN ' and more' ELSE '' END END AS name FROM supplier")
def fn_clean_description(t: Tables) -> DataFrame:
    raw = """CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN s_name || ' [Source:A] and more [Source:B]' WHEN 2 THEN ' ' || s_name || '  [Source:HGNC Symbol;Acc:HGNC:1]' ELSE s_name END"""
    rows = t.sql(f"SELECT s_suppkey AS k, {raw} AS raw FROM supplier")
    return rows.select("k", associations.clean_description(F.col("raw")).alias("name"))


@query(
    "fn_pgx_summary",
    f"""SELECT trim(lower(drugname)) AS drug_name, genesymbol AS gene, 'CPIC' AS guideline_source, guidelineurl AS guideline_url, 'CPIC Level ' || cpiclevel || ' drug-gene pair.'
               || CASE WHEN pgxtesting <> '' THEN ' PGx testing: ' || pgxtesting || '.' ELSE '' END AS clinical_summary, cpiclevel AS cpic_level, nullif(pgxtesting, '') AS pgx_testing
        FROM ({CPIC_SOURCES['pair']}) p WHERE genesymbol <> ''""",
)
def fn_pgx_summary(t: Tables) -> DataFrame:
    return reference_builds.drug_table(t.sql(CPIC_SOURCES["pair"]))


@query("fn_gene_split", "SELECT k, trim(unnest(string_split(mapped_gene, ' - '))) AS symbol FROM d_gwas")
def fn_gene_split(t: Tables) -> DataFrame:
    return t.view("d_gwas").select("k", F.explode(associations.gene_symbols(F.col("mapped_gene"))).alias("symbol"))


@query("fn_freq_struct", "SELECT k, af IS NOT NULL OR af_grpmax IS NOT NULL AS known, af AS overall, af_grpmax AS popmax FROM d_sites")
def fn_freq_struct(t: Tables) -> DataFrame:
    rows = t.sites.select("k", vcf_fields.frequency_struct(F.col("af"), F.col("af_grpmax")).alias("f"))
    return rows.select("k", F.col("f").isNotNull().alias("known"), F.col("f.global").alias("overall"), "f.popmax")
