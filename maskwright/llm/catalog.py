"""The subpackage's registered queries and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op7_neighbours
from .chat import op4_chat
from .langid import op9_language
from .licenses import op5_licenses
from .main_text import op13_main_text
from .media import op8_media
from .mixing import op10_mix
from .ngram_join import op6_ngram_join
from .packing import op3_pack
from .periodic import op12_runs
from .quality import op1_quality
from .ranking import OP11_SQL, op11_ranked
from .secret_scan import op2_secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_pack": op3_pack,
    "op4_chat": op4_chat,
    "op5_licenses": op5_licenses,
    "op6_ngram_join": op6_ngram_join,
    "op7_neighbours": op7_neighbours,
    "op8_media": op8_media,
    "op9_language": op9_language,
    "op10_mix": op10_mix,
    "op11_ranked": op11_ranked,
    "op12_runs": op12_runs,
    "op13_main_text": op13_main_text,
}

ORACLE_SQL: dict[str, str] = {"op11_ranked": OP11_SQL}
