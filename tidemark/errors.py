"""Errors, with the operator that raised them."""

from __future__ import annotations

import re


class FlowError(Exception):
    """Root of the engine's errors."""


class ConfigError(FlowError, ValueError):
    """An operator was asked for something that it cannot be built with."""


class DuplicateName(ConfigError):
    """Two inputs or outputs of one flow have the same name."""


class OperatorError(FlowError):
    """An operator failed while it ran."""

    def __init__(self, operator: str, cause: BaseException, partition: int | None = None):
        super().__init__(f"{operator}: {cause}")
        self.operator, self.cause, self.partition = operator, cause, partition


_MARK = re.compile(r"\[operator (.+?), partition (-?\d+)\]")


def marked(operator: str, partition: int, cause: BaseException) -> str:
    """A message that tells of an operator and its partition, through the engine to the driver."""
    return str(cause) if _MARK.search(str(cause)) else f"[operator {operator}, partition {partition}] {type(cause).__name__}: {cause}"


def located(flow: str, cause: BaseException) -> OperatorError:
    """The error of a flow, with the operator and partition that it tells of, if it does."""
    m = _MARK.search(str(cause))
    return OperatorError(m[1], cause, int(m[2])) if m else OperatorError(flow, cause)


class Cancelled(FlowError):
    """A run was cancelled; reason says by what."""

    def __init__(self, reason: str = "user"):
        super().__init__(f"cancelled: {reason}")
        self.reason = reason


class NotConverged(FlowError):
    """A loop still had feedback after its last allowed round."""
