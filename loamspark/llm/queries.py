"""Registered queries of this subpackage; oracle SQL where SQL can express a query."""

from loamspark.llm.bpe import op1_bpe_round_trip
from loamspark.llm.langid import op8_language_id
from loamspark.llm.lengths import op10_token_counts
from loamspark.llm.minhash import op9_near_duplicates
from loamspark.llm.mix import op6_mix_sources
from loamspark.llm.mpeg import op7_mpeg_audio
from loamspark.llm.passages import op4_repeated_passages
from loamspark.llm.pii import op5_pii
from loamspark.llm.secrets import op2_secret_scan
from loamspark.llm.vectors import op3_vector_near_dups

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_secret_scan,
        op3_vector_near_dups,
        op4_repeated_passages,
        op5_pii,
        op6_mix_sources,
        op7_mpeg_audio,
        op8_language_id,
        op9_near_duplicates,
        op10_token_counts,
    )
}
ORACLE: dict[str, str] = {}
