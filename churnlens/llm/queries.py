"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from .chunk_tokens import op11_chunk_tokens
from .collocations import OP12_SQL, op12_collocations
from .decontaminate import op8_decontaminate
from .language_id import op10_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import OP5_SQL, op5_mix_sources
from .quality_classifier import op4_quality_classifier
from .quality_rules import OP7_SQL, op7_quality_rules
from .simhash_dedup import op2_simhash_dedup
from .source_audit import OP13_SQL, op13_source_audit
from .substring_dedup import op9_substring_dedup
from .token_files import op6_token_files
from .url_filter import op3_url_filter

QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_simhash_dedup, op3_url_filter, op4_quality_classifier, op5_mix_sources,
    op6_token_files, op7_quality_rules, op8_decontaminate, op9_substring_dedup, op10_language_id,
    op11_chunk_tokens, op12_collocations, op13_source_audit)}

#: SQL has no XXH64, trained model, zstandard or tokenizer; the other queries are tested
#: against plain Python in tests/llm.
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op5_mix_sources": OP5_SQL, "op7_quality_rules": OP7_SQL,
              "op12_collocations": OP12_SQL, "op13_source_audit": OP13_SQL}
