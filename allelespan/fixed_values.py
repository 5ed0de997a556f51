"""Published lists that results depend on."""

# Secondary-findings genes (version 3.3), clinically actionable and so never on the warning list.
ACTIONABLE_GENES = """
APC BMPR1A BRCA1 BRCA2 BRIP1 CDH1 CDK4 CDKN2A CHEK2 DICER1 EPCAM GREM1 HOXB13 KIT MAX MEN1 MET MLH1 MSH2 MSH6 MUTYH NF2 NTHL1
PALB2 PDGFRA PMS2 POLD1 POLE PTEN RAD51C RAD51D RB1 RET SDHA SDHAF2 SDHB SDHC SDHD SMAD4 STK11 TMEM127 TP53 TSC1 TSC2 VHL
ACTA2 ACTC1 APOB COL3A1 DSC2 DSG2 DSP FBN1 FLNC GLA HFE KCNH2 KCNQ1 LDLR LMNA MYBPC3 MYH11 MYH7 MYL2 MYL3 PCSK9 PKP2 PLN
RBM20 RPE65 RYR2 SCN5A SMAD3 TGFBR1 TGFBR2 TMEM43 TNNC1 TNNI3 TNNT2 TPM1 TRDN TTN TTR
ATP7B BTD GAA OTC RYR1
""".split()

# Phenotype terms for early death and progressive neurodegeneration.
SEVERE_PHENOTYPES = """
HP:0003826 HP:0003811 HP:0001522 HP:0003819 HP:0011421 HP:0100613 HP:0033041
HP:0002180 HP:0001268 HP:0002344 HP:0007272 HP:0006964 HP:0007064 HP:0002529
""".split()

# Polygenic scores and their traits; all of their weights are used.
PUBLISHED_SCORES = [
    ("PGS000010", "Coronary artery disease"),
    ("PGS000349", "Coronary artery disease"),
    ("PGS000074", "Colorectal cancer"),
    ("PGS002251", "Body mass index (BMI)"),
]

# RefSeq accessions of the GRCh38 chromosomes.
GRCH38_ACCESSIONS = [
    ("NC_000001.11", "1"),
    ("NC_000002.12", "2"),
    ("NC_000003.12", "3"),
    ("NC_000004.12", "4"),
    ("NC_000005.10", "5"),
    ("NC_000006.12", "6"),
    ("NC_000007.14", "7"),
    ("NC_000008.11", "8"),
    ("NC_000009.12", "9"),
    ("NC_000010.11", "10"),
    ("NC_000011.10", "11"),
    ("NC_000012.12", "12"),
    ("NC_000013.11", "13"),
    ("NC_000014.9", "14"),
    ("NC_000015.10", "15"),
    ("NC_000016.10", "16"),
    ("NC_000017.11", "17"),
    ("NC_000018.10", "18"),
    ("NC_000019.10", "19"),
    ("NC_000020.11", "20"),
    ("NC_000021.9", "21"),
    ("NC_000022.11", "22"),
    ("NC_000023.11", "X"),
    ("NC_000024.10", "Y"),
    ("NC_012920.1", "MT"),
]
