"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from .bwt_dedup import OP8_SQL, op8_bwt_dedup
from .chat import OP3_SQL, op3_chat
from .decontam import op10_decontam
from .html_crf import op2_html_crf
from .langid import op6_langid
from .ngram_join import OP4_SQL, op4_ngram_join
from .packing import op5_packing
from .topk import OP9_SQL, op9_topk
from .urls import OP7_SQL, op7_urls
from .warc import OP1_SQL, op1_warc


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_html_crf": op2_html_crf,
        "op3_chat": op3_chat,
        "op4_ngram_join": op4_ngram_join,
        "op5_packing": op5_packing,
        "op6_langid": op6_langid,
        "op7_urls": op7_urls,
        "op8_bwt_dedup": op8_bwt_dedup,
        "op9_topk": op9_topk,
        "op10_decontam": op10_decontam,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_chat": OP3_SQL, "op4_ngram_join": OP4_SQL, "op7_urls": OP7_SQL, "op8_bwt_dedup": OP8_SQL, "op9_topk": OP9_SQL}
