"""The operators' queries and their SQL, for the registry at the repository's top."""

from tessera.llm import bpe, embedding_dedup, exact_dedup, license_scan, ngram_join, packing, periodic_runs, pii, quality, token_records, toxicity, warc, whitening

QUERIES = {
    f.__name__: f for f in (
        license_scan.op1_license_scan, license_scan.op1_license_variants, exact_dedup.op2_exact_dedup, pii.op3_pii, ngram_join.op4_ngram_join, ngram_join.op4_ngram_links, toxicity.op5_toxicity, bpe.op6_bpe,
        packing.op7_packing, warc.op8_warc, embedding_dedup.op9_embedding_dedup, quality.op10_quality_classifier, periodic_runs.op11_periodic_runs, token_records.op12_token_records, whitening.op13_whitening)
}
ORACLE_SQL = {"op1_license_scan": license_scan.op1_sql(), "op1_license_variants": license_scan.op1_sql(license_scan.VARIANTS), "op2_exact_dedup": exact_dedup.OP2_SQL, "op8_warc": warc.OP8_SQL}
