"""Structured Streaming twins of the per-epoch operators."""

from .sealed import close_time, deduplicated, epoch_aggregate, merged, revised, sealed, sums_of
from .state import NotifyAt, NotifyEpochs, RunningSum

__all__ = ["NotifyAt", "NotifyEpochs", "RunningSum", "close_time", "deduplicated", "epoch_aggregate", "merged", "revised", "sealed", "sums_of"]
