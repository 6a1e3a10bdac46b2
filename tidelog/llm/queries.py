"""The queries of this folder, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tidelog.llm import licenses, minhash, vecdedup
from tidelog.llm.ann import op8_nearest_neighbours
from tidelog.llm.langid import op10_language_id
from tidelog.llm.licenses import op2_license_scan
from tidelog.llm.minhash import op6_minhash_dedup
from tidelog.llm.mixing import op5_mixing
from tidelog.llm.packing import op3_packing
from tidelog.llm.secrets import op7_secret_scan
from tidelog.llm.toxicity import op1_toxicity
from tidelog.llm.vecdedup import op9_vector_dedup
from tidelog.llm.wavelet import op4_token_output

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_token_output": op4_token_output,
    "op5_mixing": op5_mixing,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op6_minhash_dedup": minhash.oracle(),
    "op9_vector_dedup": vecdedup.oracle(),
}
