"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sievegrid.llm import fim, lines, lloyd, mixing, topk, warc
from sievegrid.llm.collisions import op11_collisions
from sievegrid.llm.fim import op13_fim
from sievegrid.llm.lines import op10_lines
from sievegrid.llm.lloyd import op12_deltalloyd
from sievegrid.llm.mixing import op7_mixing
from sievegrid.llm.maintext import op8_maintext
from sievegrid.llm.multiindex import op6_multiindex
from sievegrid.llm.packing import op5_packing
from sievegrid.llm.quality import op3_quality
from sievegrid.llm.simhash import op4_simhash
from sievegrid.llm.topk import op1_topk
from sievegrid.llm.urlfilter import op2_urlfilter
from sievegrid.llm.warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_urlfilter": op2_urlfilter,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_multiindex": op6_multiindex,
    "op7_mixing": op7_mixing,
    "op8_maintext": op8_maintext,
    "op9_warc": op9_warc,
    "op10_lines": op10_lines,
    "op11_collisions": op11_collisions,
    "op12_deltalloyd": op12_deltalloyd,
    "op13_fim": op13_fim,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_topk": topk.SQL,
    "op7_mixing": mixing.SQL,
    "op9_warc": warc.SQL,
    "op10_lines": lines.SQL,
    "op12_deltalloyd": lloyd.SQL,
    "op13_fim": fim.SQL,
}
