"""The registered queries of the dealt operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sealwright.llm import (
    language,
    mixing,
    packing,
    pii,
    pivots,
    postings,
    quality,
    repeats,
    signatures,
    simhash,
    token_scan,
    toxicity,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_quality_rules": quality.query,
        "op3_personal_data": pii.query,
        "op4_source_mixing": mixing.query,
        "op5_language_id": language.query,
        "op6_toxicity": toxicity.query,
        "op7_packing": packing.query,
        "op8_embedding_near_dedup": pivots.query,
        "op9_repeated_passages": repeats.query,
        "op10_token_counts": token_scan.query,
        "op11_embedding_whitening": whitening.query,
        "op12_ranked_search": signatures.query,
        "op13_benchmark_decontamination": postings.query,
    }


#: All pairs and their closure. The folds and hashes of the other queries (crc32, XXH64), their models and
#: tokenizers are not in SQL; tests/llm hold those against brute force.
_PAIRS_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
usable as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
           and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from usable a join usable b
          on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select v.vec_id, coalesce(n.n_links, 0) as n_links, least.component_id, v.vec_id = least.component_id as kept
from v join least on least.a = v.vec_id left join n on n.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_embedding_near_dedup": _PAIRS_SQL,
        "op12_ranked_search": signatures.SQL,
        "op13_benchmark_decontamination": postings.SQL,
    }
