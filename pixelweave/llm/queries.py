"""Queries of the numbered operators over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, centroids, decontamination, filter_audit, licenses, lines, media, neardup, neighbours, pii, suffixes, token_counts, toxicity


def queries() -> dict[str, Callable]:
    return {"op1_toxicity": toxicity.op1, "op2_pii": pii.op2, "op3_line_dedup": lines.op3, "op4_suffix_dedup": suffixes.op4, "op5_decontamination": decontamination.op5,
            "op6_near_duplicates": neardup.op6, "op7_bpe": bpe.op7, "op8_media": media.op8, "op9_licenses": licenses.op9, "op10_token_counts": token_counts.op10,
            "op11_filter_audit": filter_audit.op11, "op12_neighbours": neighbours.op12, "op13_centroids": centroids.op13}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": lines.OP3_SQL, "op11_filter_audit": filter_audit.OP11_SQL, "op13_centroids": centroids.op13_sql()}
