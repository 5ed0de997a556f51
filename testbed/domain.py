"""Domain tables derived from the driver's Parquet tables.

Each view is one SELECT that Spark and DuckDB read alike, so both sides of a check start from the same
input. A view covers the whole of the table it comes from. The views only lay out input data; what is
checked (parsers, joins, filters, aggregates) is written twice, as DataFrame code and as oracle SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _chrom(key: str) -> str:
    return f"CASE {key} % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE cast(1 + {key} % 25 AS string) END"


_BASE = "substr('ACGT', cast(1 + {} % 4 AS int), 1)"

VIEWS = {
    # one variant site per part, with everything the layers know about it
    "d_sites": f"""
        SELECT k, {_chrom('k')} AS chrom, 1000 + k * 37 AS pos,
               CASE WHEN k % 17 = 0 THEN 'ATCT' ELSE {_BASE.format('k')} END AS ref,
               CASE WHEN k % 17 = 0 THEN 'A'
                    WHEN k % 29 = 0 THEN {_BASE.format('(k + 1)')} || ',' || {_BASE.format('(k + 2)')}
                    ELSE {_BASE.format('(k + 1)')} END AS alt,
               CASE WHEN k % 10 < 4 THEN 'rs' || cast(CASE WHEN k % 50 = 1 THEN k - 1 ELSE k END AS string) END AS vcf_id,
               CASE WHEN k % 5 <> 0 THEN 'rs' || cast(CASE WHEN k % 50 = 1 THEN k - 1 ELSE k END AS string) END AS dbsnp_id,
               CASE WHEN annotated THEN brand END AS gene,
               CASE WHEN annotated THEN lower(p_type) || '_variant' END AS effect,
               CASE WHEN annotated THEN CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END END AS impact,
               CASE WHEN annotated THEN 'ENST' || cast(10000000 + k AS string) END AS transcript,
               CASE WHEN annotated THEN 'c.' || cast(k AS string) || 'A>G' END AS hgvs_c,
               CASE WHEN annotated THEN CASE WHEN k % 3 = 0 THEN '' ELSE 'p.Ala' || cast(k AS string) || 'Gly' END END AS hgvs_p,
               clnsig,
               CASE WHEN clnsig IS NOT NULL THEN CASE WHEN k % 8 = 0 THEN '.' ELSE replace(p_name, ' ', '_') END END AS clndn,
               CASE WHEN clnsig IS NOT NULL THEN CASE k % 5 WHEN 0 THEN 'criteria_provided,_single_submitter'
                    WHEN 1 THEN 'reviewed_by_expert_panel' WHEN 2 THEN '.' WHEN 3 THEN 'no_assertion_criteria_provided' END END AS clnrevstat,
               CASE WHEN k % 6 <> 0 THEN cast(k % 1000 AS double) / 1000 END AS af,
               CASE WHEN k % 4 <> 0 THEN cast(k * 3 % 1000 AS double) / 1000 END AS af_grpmax,
               brand, p_size, p_name
        FROM (SELECT p_partkey AS k, upper(replace(p_brand, '#', '')) AS brand, p_type, p_size, p_name,
                     p_partkey % 7 <> 3 AND p_partkey % 23 <> 5 AS annotated,
                     CASE p_partkey % 13 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic'
                          WHEN 2 THEN 'Pathogenic/Likely_pathogenic' WHEN 3 THEN 'Benign' WHEN 4 THEN 'Likely_benign'
                          WHEN 5 THEN 'drug_response' WHEN 6 THEN 'risk_factor'
                          WHEN 7 THEN 'Conflicting_interpretations_of_pathogenicity'
                          WHEN 8 THEN 'Uncertain_significance' WHEN 9 THEN 'Benign/Likely_benign' END AS clnsig
              FROM part) parts""",
    "d_annotations": """
        SELECT chrom, pos, ref, alt, coalesce(vcf_id, dbsnp_id) AS rsid,
               CASE WHEN vcf_id IS NOT NULL THEN 'vcf' WHEN dbsnp_id IS NOT NULL THEN 'dbsnp' END AS rsid_source,
               gene, effect, impact, transcript, hgvs_c, hgvs_p, clnsig, clndn, clnrevstat, af, af_grpmax
        FROM d_sites""",
    # one genome per supplier; a call per (supplier, part) that occurs in lineitem
    "d_calls": """
        SELECT 'g' || cast(s AS string) AS genome, chrom, pos, vcf_id AS id, ref,
               CASE WHEN o % 12 = 11 THEN 'ACGT' || ref ELSE alt END AS alt,
               CASE o % 11 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' WHEN 3 THEN '0|1' WHEN 4 THEN './.'
                           WHEN 5 THEN '1|0' WHEN 6 THEN '1/2' WHEN 7 THEN '1' WHEN 8 THEN '.|.' WHEN 9 THEN '0/.' ELSE '0/1/1' END AS gt,
               CASE WHEN s % 3 = 0 THEN CASE WHEN chrom = 'MT' THEN 'chrM' ELSE 'chr' || chrom END ELSE chrom END AS contig,
               s, d_sites.k AS k, o
        FROM (SELECT l_suppkey AS s, l_partkey AS k, min(l_orderkey + l_linenumber) AS o
              FROM lineitem GROUP BY l_suppkey, l_partkey) pairs
        JOIN d_sites ON pairs.k = d_sites.k""",
    "d_genes": f"""
        SELECT CASE WHEN s_suppkey < 25 THEN 'BRAND' || cast(s_suppkey + 1 AS string) ELSE upper(replace(s_name, '#', '')) END AS symbol,
               'gene of ' || s_name AS name, {_chrom('s_suppkey')} AS chrom,
               1000 + s_suppkey * 700 AS start_pos, 1000 + s_suppkey * 700 + 5000 + s_suppkey % 7 * 3000 AS end_pos,
               CASE WHEN s_nationkey % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM supplier""",
    "d_pgx_drugs": """
        SELECT lower(n_name) AS drug_name, 'BRAND' || cast(1 + n_nationkey % 25 AS string) AS gene, 'CPIC' AS guideline_source,
               CASE WHEN n_nationkey % 2 = 0 THEN 'https://example.org/' || cast(n_nationkey AS string) END AS guideline_url,
               'summary of ' || n_name AS clinical_summary, CASE WHEN n_nationkey % 4 = 3 THEN 'B' ELSE 'A' END AS cpic_level,
               CASE n_regionkey WHEN 0 THEN 'Actionable PGx' WHEN 1 THEN 'Testing required' END AS pgx_testing
        FROM nation""",
    # each supplier stands for an allele that two sites define
    "d_pgx_variants": """
        SELECT brand AS gene, coalesce(vcf_id, dbsnp_id) AS rsid, chrom, pos, ref, alt, '*' || cast(1 + d_sites.k % 7 AS string) AS star_allele,
               CASE d_sites.k % 3 WHEN 0 THEN 'No function' WHEN 1 THEN 'Decreased function' END AS function_impact, cast(NULL AS string) AS notes
        FROM (SELECT s_suppkey * 19 AS k FROM supplier UNION SELECT s_suppkey * 13 + 2 FROM supplier) defining
        JOIN d_sites ON defining.k = d_sites.k""",
    "d_prs": f"""
        SELECT 'PGS' || c_mktsegment AS prs_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Shared trait' ELSE lower(c_mktsegment) || ' trait' END AS trait,
               'rs' || cast(c_custkey AS string) AS rsid, {_chrom('c_custkey')} AS chrom, 1000 + c_custkey * 37 AS pos,
               substr('ACGT', cast(1 + (c_custkey + c_custkey % 2) % 4 AS int), 1) AS effect_allele, c_acctbal / 10000 AS weight
        FROM customer""",
    "d_gwas": f"""
        SELECT CASE WHEN o_orderkey % 50 <> 0 THEN 'rs' || cast(o_custkey AS string) END AS rsid, {_chrom('o_custkey')} AS chrom,
               1000 + o_custkey * 37 AS pos,
               CASE WHEN o_orderkey % 40 <> 7 THEN 'BRAND' || cast(1 + o_custkey % 25 AS string)
                    || CASE WHEN o_orderkey % 3 = 0 THEN ' - BRAND' || cast(1 + o_orderkey % 25 AS string) ELSE '' END END AS mapped_gene,
               CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END AS trait,
               CASE WHEN o_orderkey % 4 <> 1 THEN 'status ' || o_orderstatus END AS mapped_trait,
               CASE WHEN o_orderkey % 5 <> 2 THEN substr('ACGT', cast(1 + o_orderkey % 4 AS int), 1) END AS risk_allele,
               CASE WHEN o_orderkey % 9 <> 4 THEN cast(o_orderkey % 100 AS double) / 100 END AS risk_allele_freq,
               CASE WHEN o_orderkey % 17 <> 0 THEN 1 / o_totalprice END AS p_value,
               CASE WHEN o_orderkey % 6 <> 1 THEN o_totalprice / 100000 END AS or_beta,
               CASE WHEN o_orderkey % 8 <> 3 THEN '[' || cast(o_orderkey % 10 AS string) || '-10] unit' END AS ci_text,
               cast(20000000 + o_custkey AS string) AS pubmed_id, 'Author ' || cast(o_custkey % 97 AS string) AS first_author,
               'GCST' || cast(90000000 + o_orderkey AS string) AS study_accession, o_orderkey AS k
        FROM orders""",
    # brands of mostly large parts
    "d_warning_genes": """
        SELECT upper(replace(p_brand, '#', '')) AS symbol FROM part
        GROUP BY upper(replace(p_brand, '#', '')) HAVING 2 * sum(p_size) > 51 * count(*)""",
    "d_genomes": "SELECT DISTINCT 'g' || cast(l_suppkey AS string) AS genome, l_suppkey AS s FROM lineitem",
}


def _with_clause(text: str, wanted: list[str]) -> list[str]:
    """Views that ``text`` needs, dependencies first."""
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text) and name not in wanted:
            _with_clause(VIEWS[name], wanted)
            wanted.append(name)
    return wanted


def oracle(query: str) -> str:
    """Oracle SQL with the views it uses in front."""
    views = [f"{name} AS ({VIEWS[name]})" for name in _with_clause(query, [])]
    text = query.strip()
    if text.upper().startswith("WITH "):
        views.append(text[5:].lstrip())
        return "WITH " + ",\n".join(views)
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + text


def spark_sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """A SELECT over driver tables and views, as a lazy DataFrame."""
    names = _with_clause(query, [])
    text = query + " ".join(VIEWS[name] for name in names)
    tables = [name for name in DRIVER_TABLES if re.search(rf"\b{name}\b", text)]
    parts = [f"{name} AS (SELECT * FROM parquet.`{sf_dir.rstrip('/')}/{name}.parquet`)" for name in tables]
    parts += [f"{name} AS ({VIEWS[name]})" for name in names]
    return spark.sql("WITH " + ",\n".join(parts) + "\n" + query)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table, with the types the library expects."""
    df = spark_sql(spark, sf_dir, f"SELECT * FROM {name}")
    longs = [c for c in ("pos", "start_pos", "end_pos") if c in df.columns]
    for column in longs:
        df = df.withColumn(column, df[column].cast("bigint"))
    return df
