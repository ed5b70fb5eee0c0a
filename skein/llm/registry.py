"""The queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import conversation, lexical, topk, url_filter, warc
from skein.llm.conversation import op13_conversations
from skein.llm.decontaminate import op3_decontamination
from skein.llm.huffman import op10_token_files
from skein.llm.language_id import op8_language
from skein.llm.lexical import op12_lexical
from skein.llm.lm_score import op5_lm_score
from skein.llm.packing import op1_packing
from skein.llm.secret_scan import op4_secrets
from skein.llm.sharding import op11_sharding
from skein.llm.simhash import op2_simhash
from skein.llm.topk import op7_topk
from skein.llm.url_filter import op6_url_filter
from skein.llm.warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_lm_score": op5_lm_score,
    "op6_url_filter": op6_url_filter,
    "op7_topk": op7_topk,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_token_files": op10_token_files,
    "op11_sharding": op11_sharding,
    "op12_lexical": op12_lexical,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op6_url_filter": url_filter.ORACLE,
    "op7_topk": topk.ORACLE,
    "op9_warc": warc.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "op13_conversations": conversation.ORACLE,
}
