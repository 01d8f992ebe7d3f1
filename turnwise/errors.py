"""Typed errors: a stable code, a message and structured detail."""

from __future__ import annotations

from typing import Any


class AnalyticsError(ValueError):
    """Raised at plan time when an operator cannot apply to its input."""

    def __init__(self, code: str, message: str, detail: dict[str, Any] | None = None) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
        self.detail = detail or {}
