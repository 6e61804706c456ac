"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import conversations, decontamination, language, licenses, neardup, negatives, packing, pii, repetition, sharding, substrings, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontamination.op1_decontaminate,
    "op2_pii": pii.op2_pii,
    "op3_warc": warc.op3_warc,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_neardup": neardup.op5_neardup,
    "op6_pack": packing.op6_pack,
    "op7_repetition": repetition.op7_repetition,
    "op8_licenses": licenses.op8_licenses,
    "op9_shard": sharding.op9_shard,
    "op10_language": language.op10_language,
    "op11_trie": conversations.op11_trie,
    "op12_substrings": substrings.op12_substrings,
    "op13_negatives": negatives.op13_negatives,
    "pii_base_kinds": pii.pii_base_kinds,
}

ORACLE = {"pii_base_kinds": pii.ORACLE, "op1_decontaminate": decontamination.ORACLE, "op3_warc": warc.ORACLE, "op5_neardup": neardup.ORACLE, "op7_repetition": repetition.ORACLE, "op8_licenses": licenses.ORACLE, "op9_shard": sharding.ORACLE, "op11_trie": conversations.ORACLE, "op12_substrings": substrings.ORACLE, "op13_negatives": negatives.ORACLE}
