"""Registry of the corpus queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenetables.llm.decontamination import OP8_SQL, op8_decontamination
from scenetables.llm.language_id import op7_language_id
from scenetables.llm.mixing import OP4_SQL, op4_source_mixing
from scenetables.llm.pii import op3_pii
from scenetables.llm.pivot_clusters import OP11_SQL, op11_centroid_clusters
from scenetables.llm.secret_scan import op10_secret_scan
from scenetables.llm.simhash_dedup import op1_simhash_near_dedup
from scenetables.llm.suffix_dedup import op2_suffix_dedup
from scenetables.llm.token_counts import op13_token_counts
from scenetables.llm.toxicity import op5_toxicity
from scenetables.llm.transport_stream import op6_transport_stream
from scenetables.llm.url_filter import OP9_SQL, op9_url_filter
from scenetables.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_suffix_dedup,
        op3_pii,
        op4_source_mixing,
        op5_toxicity,
        op6_transport_stream,
        op7_language_id,
        op8_decontamination,
        op9_url_filter,
        op10_secret_scan,
        op11_centroid_clusters,
        op12_vector_codes,
        op13_token_counts,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
