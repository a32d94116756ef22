"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from orderweave.llm import exact_search, licenses, near_dedup, substring_dedup, suffix_dedup, url_filter
from orderweave.llm.byte_bpe import op5
from orderweave.llm.collision_search import op10
from orderweave.llm.conversations import op11
from orderweave.llm.exact_search import op1
from orderweave.llm.licenses import op3
from orderweave.llm.line_quality import op2
from orderweave.llm.mixing import op7
from orderweave.llm.near_dedup import op8
from orderweave.llm.substring_dedup import op4
from orderweave.llm.suffix_dedup import op9
from orderweave.llm.toxicity import op6
from orderweave.llm.url_filter import op13
from orderweave.llm.whitening import op12

QUERIES = {
    "op1_exact_top_k": op1,
    "op2_line_quality": op2,
    "op3_license_scan": op3,
    "op4_substring_dedup": op4,
    "op5_byte_bpe": op5,
    "op6_toxicity": op6,
    "op7_source_mixing": op7,
    "op8_near_dedup": op8,
    "op9_suffix_dedup": op9,
    "op10_collision_search": op10,
    "op11_conversation_repair": op11,
    "op12_whitening": op12,
    "op13_url_filter": op13,
}

SQL: dict[str, str] = {
    "op1_exact_top_k": exact_search.SQL,
    "op3_license_scan": licenses.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
    "op13_url_filter": url_filter.SQL,
}
