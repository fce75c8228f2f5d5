"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestream.llm.bpe import op7_bpe
from lodestream.llm.centroids import OP12_SQL, op12_centroids
from lodestream.llm.embedding_dedup import op4_embedding_dedup
from lodestream.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from lodestream.llm.language_id import op6_language_id
from lodestream.llm.mixing import OP8_SQL, op8_mixing
from lodestream.llm.quality import op3_quality
from lodestream.llm.secrets import op5_secrets
from lodestream.llm.sharding import op10_sharding
from lodestream.llm.simhash import op9_simhash
from lodestream.llm.spelling import op11_spelling
from lodestream.llm.token_counts import op13_token_counts
from lodestream.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_secrets": op5_secrets,
    "op6_language_id": op6_language_id,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_spelling": op11_spelling,
    "op12_centroids": op12_centroids,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op8_mixing": OP8_SQL, "op12_centroids": OP12_SQL}
