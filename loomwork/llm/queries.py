"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import html, infill, langid, licences, lm, media, mixing, neighbours, periodic, pieces, sharding, simhash, urls


def queries():
    return {
        "op1_language_id": langid.query,
        "op2_url_filter": urls.query,
        "op3_mixing": mixing.query,
        "op4_sharding": sharding.query,
        "op5_nearest_neighbours": neighbours.query,
        "op6_simhash_near_dedup": simhash.query,
        "op7_html_extraction": html.query,
        "op8_sentencepiece": pieces.query,
        "op9_lm_scoring": lm.query,
        "op10_media_columns": media.query,
        "op11_periodic_runs": periodic.query,
        "op12_license_scan": licences.query,
        "op13_fill_in_middle": infill.query,
    }


def oracle_sql():
    return {
        "op2_url_filter": urls.ORACLE_SQL,
        "op3_mixing": mixing.oracle_sql(),
        "op12_license_scan": licences.oracle_sql(),
        "op13_fill_in_middle": infill.ORACLE_SQL,
    }
