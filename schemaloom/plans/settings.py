"""Settings of runs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """temperatures: comma-separated; what can't be read as a number is left out."""

    temperatures: str = "0.2,0.6,0.9"
    sample_rows: int = 20
    repeats: int = 1
    attempts: int = 2
    pause: float = 1.5

    def temperature_list(self) -> list[float]:
        found = []
        for part in self.temperatures.split(","):
            try:
                found.append(float(part))
            except ValueError:
                continue
        return found or [0.2, 0.6, 0.9]
