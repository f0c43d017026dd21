"""The queries of this package and their SQL, by name."""

from tidemark.llm import bpe, centroids, gif, html, language, mixing, neardup, packing, pii, quality, rules, runs, secrets

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_language_id": language.op2,
    "op3_pii_contextual": pii.op3,
    "pii_planted": pii.planted,
    "op4_gif_frames": gif.op4,
    "op5_quality_classifier": quality.op5,
    "op6_source_mixing": mixing.op6,
    "op7_jaccard_components": neardup.op7,
    "op8_bpe_roundtrip": bpe.op8,
    "op9_quality_rules": rules.op9,
    "op10_html_extraction": html.op10,
    "op11_hamerly_clusters": centroids.op11,
    "op12_best_fit_packing": packing.op12,
    "op13_periodic_runs": runs.op13,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.oracle(),
    "op3_pii_contextual": pii.oracle(),
    "pii_planted": pii.oracle(f"(SELECT doc_id, {pii.PLANTED} AS text FROM documents)"),
    "op6_source_mixing": mixing.ORACLE,
    "op9_quality_rules": rules.oracle(),
    "op11_hamerly_clusters": centroids.oracle(),
    "op13_periodic_runs": runs.ORACLE,
}
