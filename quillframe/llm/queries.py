"""The corpus operators' queries and the SQL that checks those SQL can express."""

from __future__ import annotations

from quillframe.llm.decontaminate import op8_benchmark_leaks
from quillframe.llm.language_id import op6_language_family
from quillframe.llm.minhash_dedup import OP5_SQL, op5_minhash_near_dedup
from quillframe.llm.packing import op10_mixture_packing
from quillframe.llm.quality_rules import op3_quality_rules
from quillframe.llm.suffix_dedup import op2_suffix_array_dedup
from quillframe.llm.token_counts import op1_token_counts
from quillframe.llm.token_files import op9_token_files
from quillframe.llm.url_filters import OP7_SQL, op7_url_reputation
from quillframe.llm.warc import OP4_SQL, op4_warc_segments

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc_segments": op4_warc_segments,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_language_family": op6_language_family,
    "op7_url_reputation": op7_url_reputation,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_token_files": op9_token_files,
    "op10_mixture_packing": op10_mixture_packing,
}

#: The rest has no SQL form: byte substrings, fitted models, random walks and byte-pair encoding are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_warc_segments": OP4_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op7_url_reputation": OP7_SQL,
}
