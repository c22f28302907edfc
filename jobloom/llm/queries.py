"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe import op6_forced_boundary_bpe
from .decontamination import op1_decontamination
from .hard_negatives import op11_hard_negatives
from .language_id import op13_language_id
from .license_scan import op10_license_rules
from .line_crf import op3_line_crf
from .line_dedup import op9_window_line_dedup
from .merkle import op12_merkle_manifest
from .ngram_join import op8_ngram_join
from .pii import op7_weak_supervision_pii
from .quality_rules import op5_rule_ledger, rule_ablations
from .sharding import op4_rendezvous_shards
from .token_store import op2_token_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_frames": op2_token_frames,
    "op3_line_crf": op3_line_crf,
    "op4_rendezvous_shards": op4_rendezvous_shards,
    "op5_rule_ledger": op5_rule_ledger,
    "op6_forced_boundary_bpe": op6_forced_boundary_bpe,
    "op7_weak_supervision_pii": op7_weak_supervision_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_window_line_dedup": op9_window_line_dedup,
    "op10_license_rules": op10_license_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_id": op13_language_id,
    "rule_ablations": rule_ablations,
}

ORACLES: dict[str, str] = oracles.ORACLES
