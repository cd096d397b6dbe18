"""Queries of the operators, each over its whole table with production parameters, and DuckDB SQL where that can express them."""

from __future__ import annotations

from spanloom.llm import cube_mix, decontaminate, langid, media, near_dups, pii, secrets, sstable, substring_dedup, url_reputation


def queries() -> dict:
    return {
        "op1_sstable": sstable.query,
        "op3_url_reputation": url_reputation.query,
        "op5_cube_mix": cube_mix.query,
        "op7_media": media.query,
        "op2_pii": pii.query,
        "op4_secrets": secrets.query,
        "op6_winnowing": decontaminate.query,
        "op8_order_minhash": near_dups.query,
        "op9_fingerprint_index": substring_dedup.query,
        "op10_langid": langid.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_reputation": url_reputation.ORACLE,
        "op6_winnowing": decontaminate.ORACLE,
        "op9_fingerprint_index": substring_dedup.ORACLE,
    }
