"""Queries and SQL of the training-data operators, for the driver's registry."""

from __future__ import annotations

from plumbline.llm import decontaminate, html_extract, langid, license_scan, near_duplicates, packing, pii, quality, suffix_dedup, url_filter
from plumbline.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_pii": pii.op3_pii,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality": quality.op9_quality,
    "op10_langid": langid.op10_langid,
}
