"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP12_SQL, op12_decontaminate
from .embedding_dedup import OP6_SQL, op6_embedding_dedup
from .language_id import op3_language_id
from .media import op4_chroma_match
from .mixing import OP7_SQL, op7_mix
from .packing import op9_pack
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .ranked_search import OP11_SQL, op11_search
from .secret_scan import OP2_SQL, op2_secret_scan
from .sharding import op8_shard
from .simhash import op10_simhash
from .toxicity import op5_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_chroma_match": op4_chroma_match,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mix": op7_mix,
    "op8_shard": op8_shard,
    "op9_pack": op9_pack,
    "op10_simhash": op10_simhash,
    "op11_search": op11_search,
    "op12_decontaminate": op12_decontaminate,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_secret_scan": OP2_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op7_mix": OP7_SQL,
    "op11_search": OP11_SQL,
    "op12_decontaminate": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
