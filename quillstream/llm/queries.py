"""The corpus operators as queries, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, warc
from .centroids import op12_delta_lloyd
from .contamination import op5_contained_items
from .html_text import op10_main_text
from .line_dedup import op2_repeated_lines
from .manifest import op13_merkle_manifest
from .near_dup import op7_near_duplicates
from .packing import op3_best_fit_packing
from .passages import op1_repeated_passages
from .private_data import op4_private_spans
from .quality_model import op8_quality_classifier
from .quality_rules import op6_quality_rules
from .sharding import op9_minimax_shards
from .warc import op11_warc_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_repeated_lines": op2_repeated_lines,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_private_spans": op4_private_spans,
    "op5_contained_items": op5_contained_items,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_main_text": op10_main_text,
    "op11_warc_records": op11_warc_records,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Words of a text in SQL: runs of ASCII letters, digits and longer characters.
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op5_contained_items": f"""with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark),
 dk as (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5), ik as (select item_id, w, unnest(range(1, len(w) - 3)) as k from i where len(w) >= 5),
 ds as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from dk), items as (select distinct item_id, array_to_string(w[k:k + 4], ' ') as s from ik),
 sizes as (select item_id, count(*) as n_item from items group by item_id)
 select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, count(*) / any_value(n_item) as containment
 from ds join items using (s) join sizes using (item_id) group by doc_id, item_id having count(*) >= 0.8 * any_value(n_item)""",
    "op11_warc_records": warc.SQL,
    "op12_delta_lloyd": centroids.sql(),
}
