"""Which columns play which part in an operator."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Roles:
    """Column names of a recording: group key, time, signal, comment, tie order."""

    key: str = "source_file"
    time: str = "relative_time"
    value: str = "all_05_32_hz"
    comment: str = "comments"
    order: tuple[str, ...] = ()

    def with_(self, **changes) -> Roles:
        return replace(self, **changes)

    @property
    def sequence(self) -> tuple[str, ...]:
        """Columns that put the rows of one recording in order."""
        return (self.time, *self.order)
