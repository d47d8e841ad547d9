"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op13_bpe
from .decontaminate import op8_decontaminate
from .divergence import SQL as DIVERGENCE_SQL
from .divergence import op11_divergence
from .html_text import op9_html
from .licenses import op7_licenses
from .line_dedup import op1_lines
from .near_dedup import op10_minhash
from .pieces import op6_pieces
from .quality import SQL as QUALITY_SQL
from .quality import op5_quality
from .sharding import op4_kd_shards
from .substring_dedup import op3_substring
from .suffix_dedup import op2_suffix
from .whitening import op12_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"op1_lines": op1_lines, "op2_suffix": op2_suffix, "op3_substring": op3_substring, "op4_kd_shards": op4_kd_shards, "op5_quality": op5_quality, "op6_pieces": op6_pieces, "op7_licenses": op7_licenses, "op8_decontaminate": op8_decontaminate, "op9_html": op9_html, "op10_minhash": op10_minhash, "op11_divergence": op11_divergence, "op12_whitening": op12_whitening, "op13_bpe": op13_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": QUALITY_SQL, "op11_divergence": DIVERGENCE_SQL}
