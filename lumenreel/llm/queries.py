"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, op11_collocations
from .decontaminate import OP3_SQL, op3_decontaminate
from .langid import op2_langid
from .linededup import op4_line_dedup
from .packing import op9_packing, packed_conversations
from .patternpack import op12_pattern_packing
from .pii import op6_pii
from .simhash import op5_simhash
from .substring import OP10_SQL, op10_substring
from .topk import OP1_SQL, op1_topk
from .toxicity import op7_toxicity
from .translog import OP13_SQL, op13_transaction_log
from .warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_topk": op1_topk, "op2_langid": op2_langid, "op3_decontaminate": op3_decontaminate, "op4_line_dedup": op4_line_dedup, "op5_simhash": op5_simhash, "op6_pii": op6_pii, "op7_toxicity": op7_toxicity, "op8_warc": op8_warc, "op9_packing": op9_packing, "op10_substring": op10_substring, "op11_collocations": op11_collocations, "op12_pattern_packing": op12_pattern_packing, "op13_transaction_log": op13_transaction_log, "packed_conversations": packed_conversations}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op3_decontaminate": OP3_SQL, "op8_warc": OP8_SQL, "op10_substring": OP10_SQL, "op11_collocations": OP11_SQL, "op13_transaction_log": OP13_SQL}
