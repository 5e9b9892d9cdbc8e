"""The queries of this package and their SQL, for registration."""

from treeline.llm.chat import op9_chat_format
from treeline.llm.decontam import OP10_SQL, op10_decontaminate
from treeline.llm.html import op5_html_extract
from treeline.llm.licenses import op8_license_scan
from treeline.llm.mixing import OP4_SQL, op4_mix_sources
from treeline.llm.quality import op3_quality
from treeline.llm.simhash import op6_near_duplicates
from treeline.llm.spans import op7_sentence_spans
from treeline.llm.suffix import op1_suffix_dedup
from treeline.llm.topk import OP2_SQL, op2_top_k

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_top_k": op2_top_k,
    "op3_quality": op3_quality,
    "op4_mix_sources": op4_mix_sources,
    "op5_html_extract": op5_html_extract,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_license_scan": op8_license_scan,
    "op9_chat_format": op9_chat_format,
    "op10_decontaminate": op10_decontaminate,
}

SQL = {"op2_top_k": OP2_SQL, "op4_mix_sources": OP4_SQL, "op10_decontaminate": OP10_SQL}
