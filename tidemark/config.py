"""Every parameter of the pipeline in one frozen place; nothing reads the environment while it runs."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.text import KNOWN


@dataclass(frozen=True)
class Config:
    freq: str = "1 hour"
    lags: int = 1
    tickers: tuple[str, ...] = KNOWN
    only_unlabelled: bool = False
    sarcasm_only_live: bool = True
    target_threshold: float = 0.005
    drop_neutral: bool = True
    train: float = 0.6
    val: float = 0.2
    fill: str = "ffill"
    fill_limit: int = 24
    granger_lags: int = 4
    granger_jitter: bool = True
    ablation_filter: str = "available_only"
    ablation_least: int = 200
    up: float = 0.52
    down: float = 0.48
    boost_rounds: int = 400
    boost_depth: int = 6
    boost_rate: float = 0.05
