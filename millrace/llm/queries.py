"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import oracle
from millrace.llm.clusters import op12_clusters
from millrace.llm.decontaminate import op1_decontaminate
from millrace.llm.licenses import op3_licenses
from millrace.llm.lines import op11_lines
from millrace.llm.pages import op9_pages
from millrace.llm.phrases import op13_phrases
from millrace.llm.pieces import op10_sentencepiece
from millrace.llm.quality import op2_quality
from millrace.llm.secrets import op4_secrets
from millrace.llm.simhash import op6_simhash
from millrace.llm.topk import op8_topk
from millrace.llm.urls import op7_urls
from millrace.llm.warc import op5_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_quality": op2_quality,
        "op3_licenses": op3_licenses,
        "op4_secrets": op4_secrets,
        "op5_warc": op5_warc,
        "op6_simhash": op6_simhash,
        "op7_urls": op7_urls,
        "op8_topk": op8_topk,
        "op9_pages": op9_pages,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_lines": op11_lines,
        "op12_clusters": op12_clusters,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": oracle.op3(),
        "op4_secrets": oracle.op4(),
        "op5_warc": oracle.op5(),
        "op7_urls": oracle.op7(),
        "op8_topk": oracle.op8(),
        "op11_lines": oracle.op11(),
        "op12_clusters": oracle.op12(),
        "op13_phrases": oracle.op13(),
    }
