"""Thresholds and limits of the analysis, in one place; every plan takes a ``Params``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    #: Links of candidate components, and the mean similarity up to which groups merge.
    edge_floor: float = 0.70
    merge_threshold: float = 0.75
    #: Nearest neighbours below this are new.
    match_floor: float = 0.80
    #: Confidence from which a cluster counts as confirmed in statistics, and as a claim in views.
    confirm_threshold: float = 0.75
    claim_threshold: float = 0.80
    #: Groups from this cohesion are plain copies and rank behind others.
    copy_cohesion: float = 0.985
    max_cluster_size: int = 8
    max_candidates: int = 100
    min_loc: int = 3
    max_body_chars: int = 6000
    embed_batch: int = 256
    embed_version: str = "intent-v3"
    dimensions: int = 96


DEFAULTS = Params()
