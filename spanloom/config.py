"""Tunables of the timeline operators, in one frozen record."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    merge_gap: float = 2.0
    min_dead: float = 3.0
    visual_min_dead: float = 1.5
    min_content: float = 5.0
    edge_pad: float = 2.0
    coalesce_gap: float = 5.0
    long_run: float = 30.0
    very_long_run: float = 60.0
    cover: float = 0.5
    speech_overlap: float = 2.0
    sustained: float = 20.0
    sustained_cover: float = 0.7
    head_max: float = 180.0
    head_min: float = 2.0
    head_gap: float = 3.0
    edge_tol: float = 5.0
    min_keep: float = 0.5
    mode: str = "black"


DEFAULT = Config()
