"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from . import bpe, decontamination, divergence, exact, fingerprints, jaccard, language, orc_tokens, packing, periodic, phrases, quotes, sharding

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_language": language.op2_language,
    "op3_bpe": bpe.op3_bpe,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_quotes": quotes.op5_quotes,
    "op6_orc_tokens": orc_tokens.op6_orc_tokens,
    "op7_phrases": phrases.op7_phrases,
    "op8_packing": packing.op8_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_divergence": divergence.op12_divergence,
    "op13_decontamination": decontamination.op13_decontamination,
}
SQL = {"op10_exact_dedup": exact.OP10_SQL, "op12_divergence": divergence.OP12_SQL, "op13_decontamination": decontamination.OP13_SQL}
