"""The corpus queries of the driver's contract, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, bpe_sql, centroids, fingerprints, html, language, lines, media, minhash, mixing, quality, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_near_duplicates": minhash.op2_near_duplicates,
    "op3_quality": quality.op3_quality,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_language_id": language.op9_language_id,
    "op10_html_extraction": html.op10_html_extraction,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_bpe_by_queries": bpe_sql.op12_bpe_by_queries,
    "op13_centroid_clusters": centroids.op13_centroid_clusters,
}
ORACLES: dict[str, str] = {
    "op2_near_duplicates": minhash.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op13_centroid_clusters": centroids.ORACLE,
}
