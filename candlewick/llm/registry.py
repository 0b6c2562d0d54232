"""Queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage with query(spark, sf_dir) and, where SQL can express it, ORACLE.
MODULES = {
    "op1_byte_bpe": "byte_bpe",
    "op2_warc": "warc",
    "op3_decontamination": "decontaminate",
    "op4_line_dedup": "line_dedup",
    "op7_quality": "quality",
    "op5_exact_topk": "topk",
    "op6_toxicity": "toxicity",
    "op8_ngram_jaccard": "jaccard",
    "op9_html_extraction": "html_extract",
    "op10_suffix_dedup": "suffix_dedup",
    "op11_resampling": "resampling",
    "op12_periodic_runs": "periodic",
    "op13_packing": "packing",
}


def queries() -> dict:
    return {name: importlib.import_module(f"candlewick.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"candlewick.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
