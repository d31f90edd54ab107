"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlake.llm.bpe import op4_bpe
from flowlake.llm.brown_lm import op1_brown_lm
from flowlake.llm.conversation_trie import OP11_SQL, op11_conversation_trie
from flowlake.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from flowlake.llm.lexical_search import OP12_SQL, op12_lexical_search
from flowlake.llm.mixing import op3_mixing
from flowlake.llm.order_minhash import op5_order_minhash
from flowlake.llm.page_text import op2_page_text
from flowlake.llm.simhash import op8_simhash
from flowlake.llm.substring_dedup import op13_substring_dedup
from flowlake.llm.token_counts import op9_token_counts
from flowlake.llm.toxicity import op7_toxicity
from flowlake.llm.url_filters import OP6_SQL, op6_url_filters

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_lm": op1_brown_lm,
    "op2_page_text": op2_page_text,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_order_minhash": op5_order_minhash,
    "op6_url_filters": op6_url_filters,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_substring_dedup": op13_substring_dedup,
}

LLM_SQL: dict[str, str] = {"op6_url_filters": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op12_lexical_search": OP12_SQL}
