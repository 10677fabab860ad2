"""The queries of this subpackage, by the names that __spark_entry__.py registers."""

from __future__ import annotations

from . import embedding_dedup, fill_in_middle, language, license_scan, mixing, mpeg_audio, ngram_join, packing, quality, suffix_dedup, toxicity, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.query,
        "op2_packing": packing.query,
        "op3_mpeg_audio": mpeg_audio.query,
        "op4_mixing": mixing.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_toxicity": toxicity.query,
        "op7_language_id": language.query,
        "op8_embedding_dedup": embedding_dedup.query,
        "op9_ngram_join": ngram_join.query,
        "op10_quality": quality.query,
        "op11_fill_in_middle": fill_in_middle.query,
        "op12_license_scan": license_scan.query,
        "op13_vector_codes": vector_codes.query,
    }


def oracle_sql() -> dict[str, str]:
    """For those that SQL can express over whole tables; the others are tested against plain versions in tests/llm."""
    return {
        "op1_url_filter": url_filter.sql(),
        "op8_embedding_dedup": embedding_dedup.sql(),
        "op9_ngram_join": ngram_join.sql(),
        "op11_fill_in_middle": fill_in_middle.sql(),
        "op12_license_scan": license_scan.sql(),
        "op13_vector_codes": vector_codes.sql(),
    }
