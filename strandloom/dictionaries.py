"""Dictionaries that give types and meaning to annotation fields."""

from __future__ import annotations

# Consequence terms of the Sequence Ontology in order of severity (the place is the rank), with impact,
# functional class and genomic region.
SO_TERMS = [
    ("transcript_ablation", "HIGH", "", "transcript"),
    ("splice_acceptor_variant", "HIGH", "NONSENSE", "splice_site"),
    ("splice_donor_variant", "HIGH", "NONSENSE", "splice_site"),
    ("stop_gained", "HIGH", "NONSENSE", "exon"),
    ("frameshift_variant", "HIGH", "NONSENSE", "exon"),
    ("stop_lost", "HIGH", "NONSENSE", "exon"),
    ("start_lost", "HIGH", "NONSENSE", "exon"),
    ("transcript_amplification", "HIGH", "", "transcript"),
    ("feature_elongation", "HIGH", "", "transcript"),
    ("feature_truncation", "HIGH", "", "transcript"),
    ("inframe_insertion", "MODERATE", "MISSENSE", "exon"),
    ("inframe_deletion", "MODERATE", "MISSENSE", "exon"),
    ("missense_variant", "MODERATE", "MISSENSE", "exon"),
    ("protein_altering_variant", "MODERATE", "MISSENSE", "exon"),
    ("splice_donor_5th_base_variant", "LOW", "", "splice_site"),
    ("splice_region_variant", "LOW", "", "splice_site"),
    ("splice_donor_region_variant", "LOW", "", "splice_site"),
    ("splice_polypyrimidine_tract_variant", "LOW", "", "splice_site"),
    ("incomplete_terminal_codon_variant", "LOW", "", "exon"),
    ("start_retained_variant", "LOW", "SILENT", "exon"),
    ("stop_retained_variant", "LOW", "SILENT", "exon"),
    ("synonymous_variant", "LOW", "SILENT", "exon"),
    ("coding_sequence_variant", "MODIFIER", "", "exon"),
    ("mature_miRNA_variant", "MODIFIER", "", "exon"),
    ("5_prime_UTR_variant", "MODIFIER", "", "utr_5_prime"),
    ("3_prime_UTR_variant", "MODIFIER", "", "utr_3_prime"),
    ("non_coding_transcript_exon_variant", "MODIFIER", "", "exon"),
    ("intron_variant", "MODIFIER", "", "intron"),
    ("NMD_transcript_variant", "MODIFIER", "", "transcript"),
    ("non_coding_transcript_variant", "MODIFIER", "", "transcript"),
    ("coding_transcript_variant", "MODIFIER", "", "transcript"),
    ("upstream_gene_variant", "MODIFIER", "", "upstream"),
    ("downstream_gene_variant", "MODIFIER", "", "downstream"),
    ("TFBS_ablation", "MODIFIER", "", "tfbs"),
    ("TFBS_amplification", "MODIFIER", "", "tfbs"),
    ("TF_binding_site_variant", "MODIFIER", "", "tfbs"),
    ("regulatory_region_ablation", "MODIFIER", "", "regulatory"),
    ("regulatory_region_amplification", "MODIFIER", "", "regulatory"),
    ("regulatory_region_variant", "MODIFIER", "", "regulatory"),
    ("intergenic_variant", "MODIFIER", "", "intergenic"),
    ("sequence_variant", "MODIFIER", "", "none"),
]
RANK = {t[0]: i + 1 for i, t in enumerate(SO_TERMS)}

# Types of the sub-fields of VEP that are no text.
VEP_TYPES = {
    "CANONICAL": "boolean", "DISTANCE": "int", "AF": "float", "AFR_AF": "float", "AMR_AF": "float", "ASN_AF": "float", "EUR_AF": "float", "EAS_AF": "float", "SAS_AF": "float",
    "gnomADe_AF": "float", "gnomADe_AFR_AF": "float", "gnomADe_AMR_AF": "float", "gnomADe_ASJ_AF": "float", "gnomADe_EAS_AF": "float", "gnomADe_FIN_AF": "float", "gnomADe_MID_AF": "float",
    "gnomADe_NFE_AF": "float", "gnomADe_OTH_AF": "float", "gnomADe_SAS_AF": "float", "gnomADe_REMAINING_AF": "float",
    "gnomADg_AF": "float", "gnomADg_AFR_AF": "float", "gnomADg_AMI_AF": "float", "gnomADg_AMR_AF": "float", "gnomADg_ASJ_AF": "float", "gnomADg_EAS_AF": "float", "gnomADg_FIN_AF": "float",
    "gnomADg_MID_AF": "float", "gnomADg_NFE_AF": "float", "gnomADg_OTH_AF": "float", "gnomADg_SAS_AF": "float", "gnomADg_REMAINING_AF": "float",
    "MAX_AF": "float", "PICK": "boolean", "am_pathogenicity": "float",
}
# Sub-fields of VEP with one value per variant, not per record.
VEP_UNIFORM = (
    "VARIANT_CLASS", "AF", "AFR_AF", "AMR_AF", "EUR_AF", "EAS_AF", "SAS_AF",
    "gnomADe_AF", "gnomADe_AFR_AF", "gnomADe_AMR_AF", "gnomADe_ASJ_AF", "gnomADe_EAS_AF", "gnomADe_FIN_AF", "gnomADe_MID_AF", "gnomADe_NFE_AF", "gnomADe_SAS_AF", "gnomADe_REMAINING_AF",
    "gnomADg_AF", "gnomADg_AFR_AF", "gnomADg_AMI_AF", "gnomADg_AMR_AF", "gnomADg_ASJ_AF", "gnomADg_EAS_AF", "gnomADg_FIN_AF", "gnomADg_MID_AF", "gnomADg_NFE_AF", "gnomADg_SAS_AF",
    "gnomADg_REMAINING_AF", "MAX_AF", "MAX_AF_POPS", "Existing_variation", "CLIN_SIG", "ClinVar", "ClinVar_CLNSIG", "ClinVar_CLNDN", "ClinVar_CLNREVSTAT", "PUBMED", "PHENO", "GENE_PHENO",
)
# Types of the sub-fields of SnpEff that are no text.
SNPEFF_TYPES = {"Number_of_transcripts_in_gene": "int", "Percent_of_transcripts_affected": "float"}
# Fields of ANNOVAR that are numbers.
ANNOVAR_NUMBERS = (
    "gnomAD_exome_AF", "gnomAD_exome_AF_popmax", "gnomAD_exome_AF_male", "gnomAD_exome_AF_female", "gnomAD_exome_AF_afr", "gnomAD_exome_AF_amr", "gnomAD_exome_AF_asj", "gnomAD_exome_AF_eas",
    "gnomAD_exome_AF_fin", "gnomAD_exome_AF_nfe", "gnomAD_exome_AF_oth", "gnomAD_exome_AF_sas",
    "gnomAD_genome_AF", "gnomAD_genome_AF_popmax", "gnomAD_genome_AF_afr", "gnomAD_genome_AF_amr", "gnomAD_genome_AF_asj", "gnomAD_genome_AF_eas", "gnomAD_genome_AF_fin", "gnomAD_genome_AF_nfe",
    "gnomAD_genome_AF_oth", "gnomAD_genome_AF_sas", "AF", "AF_afr", "AF_amr", "AF_eas", "AF_eur", "AF_sas",
    "SIFT_score", "Polyphen2_HDIV_score", "Polyphen2_HVAR_score", "LRT_score", "MutationTaster_score", "MutationAssessor_score", "FATHMM_score", "PROVEAN_score", "MetaSVM_score", "MetaLR_score",
    "VEST3_score", "CADD_raw", "CADD_phred", "DANN_score", "fathmm.MKL_coding_score", "integrated_fitCons_score", "integrated_confidence_value", "GERP.._RS", "phyloP7way_vertebrate",
    "phyloP20way_mammalian", "phastCons7way_vertebrate", "phastCons20way_mammalian", "SiPhy_29way_logOdds", "AlphaMissense_score",
)
TRUE_VALUES = ("1", "T", "TRUE", "YES")
ANNOVAR_MARKS = ("ANNOVAR_DATE", "ALLELE_END")
ANNOVAR_GENE_PREFIXES = ("Func.", "Gene.", "GeneDetail.", "ExonicFunc.", "AAChange.")
# Columns of the wide FAVOR database by type.
FAVOR_COLUMNS = {
    "numeric": """vid apc_conservation apc_conservation_v2 apc_epigenetics apc_epigenetics_active apc_epigenetics_repressed apc_epigenetics_transcription apc_local_nucleotide_diversity
        apc_local_nucleotide_diversity_v2 apc_local_nucleotide_diversity_v3 apc_mappability apc_micro_rna apc_mutation_density apc_protein_function apc_protein_function_v2 apc_protein_function_v3
        apc_proximity_to_coding apc_proximity_to_coding_v2 apc_proximity_to_tsstes apc_transcription_factor bravo_an bravo_af polyphen2_hdiv_score polyphen2_hvar_score mutation_taster_score
        mutation_assessor_score fathmm_xf af_total af_asj_female af_eas_female af_afr_male af_female af_fin_male af_oth_female af_ami af_oth af_male af_ami_female af_afr af_eas_male af_sas
        af_nfe_female af_asj_male af_raw af_oth_male af_nfe_male af_asj af_amr_male af_amr_female af_sas_female af_fin af_afr_female af_sas_male af_amr af_nfe af_eas af_ami_male af_fin_female
        linsight gc cpg min_dist_tss min_dist_tse sift_val polyphen_val priphcons mamphcons verphcons priphylop mamphylop verphylop bstatistic chmm_e1 chmm_e2 chmm_e3 chmm_e4 chmm_e5 chmm_e6
        chmm_e7 chmm_e8 chmm_e9 chmm_e10 chmm_e11 chmm_e12 chmm_e13 chmm_e14 chmm_e15 chmm_e16 chmm_e17 chmm_e18 chmm_e19 chmm_e20 chmm_e21 chmm_e22 chmm_e23 chmm_e24 chmm_e25 gerp_rs
        gerp_rs_pval gerp_n gerp_s encodeh3k4me1_sum encodeh3k4me2_sum encodeh3k4me3_sum encodeh3k9ac_sum encodeh3k9me3_sum encodeh3k27ac_sum encodeh3k27me3_sum encodeh3k36me3_sum
        encodeh3k79me2_sum encodeh4k20me1_sum encodeh2afz_sum encode_dnase_sum encodetotal_rna_sum grantham freq100bp rare100bp sngl100bp freq1000bp rare1000bp sngl1000bp freq10000bp rare10000bp
        sngl10000bp remap_overlap_tf remap_overlap_cl cadd_rawscore cadd_phred k24_bismap k24_umap k36_bismap k36_umap k50_bismap k50_umap k100_bismap k100_umap nucdiv recombination_rate
        tg_afr tg_all tg_amr tg_eas tg_eur tg_sas""",
    "character": """variant_vcf variant_annovar rsid chromosome ref_annovar alt_annovar ref_vcf alt_vcf aloft_value aloft_description filter_status cage_enhancer cage_promoter cage_tc clnsig
        clnsigincl clndn clndnincl clnrevstat origin clndisdb clndisdbincl geneinfo metasvm_pred funseq_value funseq_description genecode_comprehensive_category genecode_comprehensive_info
        genecode_comprehensive_exonic_category genecode_comprehensive_exonic_info genehancer sift_cat polyphen_cat rdhs refseq_category refseq_info refseq_exonic_category refseq_exonic_info
        super_enhancer ucsc_category ucsc_info ucsc_exonic_category ucsc_exonic_info""",
    "integer": "start_position end_position position",
}
FAVOR_TYPES = {name: kind for kind, names in FAVOR_COLUMNS.items() for name in names.split()}


def vep_type(name: str) -> str:
    """Type of a sub-field; one that is not in the dictionary is text."""
    return VEP_TYPES.get(name, "string")


def vep_uniform(name: str) -> bool:
    """Whether a sub-field has one value per variant, not per record."""
    return name in VEP_UNIFORM


def snpeff_type(name: str) -> str:
    return SNPEFF_TYPES.get(name, "string")


def annovar_type(name: str) -> str:
    return "float" if name in ANNOVAR_NUMBERS else "string"


def about(name: str, root: str = "") -> str:
    """A description of a field for the tables that importers make: what it is of, in words of its name."""
    words = name.replace("_", " ").replace(".", " ").strip()
    kind = "allele frequency" if name in VEP_TYPES and name.endswith("AF") or "_AF" in name else ""
    return f"{words}{f' ({kind})' if kind else ''}{f', sub-field of {root}' if root else ''}"
