"""Driver queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, language, lines, near, quality, secrets, substring, toxicity, vectors

QUERIES = {
    "op4_secrets": secrets.op4_secrets,
    "op1_lines": lines.op1_lines,
    "op8_substring": substring.op8_substring,
    "op9_vectors": vectors.op9_vectors,
    "op2_near": near.op2_near,
    "op10_quality": quality.op10_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op7_language": language.op7_language,
    "op3_bpe": bpe.op3_bpe,
    "op6_decontaminate": decontaminate.op6_decontaminate,
}

SQL = {
    "op4_secrets": secrets.SQL,
    "op1_lines": lines.SQL,
    "op8_substring": substring.SQL,
    "op9_vectors": vectors.SQL,
    "op6_decontaminate": decontaminate.SQL,
}
