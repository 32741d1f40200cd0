"""Time constants of the signal operators; all in seconds, defaults for a feed of about two ticks a second."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TimeScale:
    candle: float = 5.0
    candle_history: float = 60.0
    history: float = 600.0
    session_gap: float = 60.0
    dwell: tuple[float, float, float] = (2.0, 8.0, 20.0)
    velocity: tuple[float, float] = (0.05, 0.30)
    horizon: float = 15.0
    round_length: float = 30.0
    play_share: float = 0.5  # of a round that is open for trade

    def scaled(self, factor: float) -> TimeScale:
        """Every duration times ``factor``, for feeds with sparser ticks."""
        return replace(
            self,
            candle=self.candle * factor,
            candle_history=self.candle_history * factor,
            history=self.history * factor,
            session_gap=self.session_gap * factor,
            dwell=tuple(x * factor for x in self.dwell),
            velocity=tuple(x / factor for x in self.velocity),
            horizon=self.horizon * factor,
            round_length=self.round_length * factor,
        )


#: The generated ``events`` table holds some hundred ticks a day and symbol: candles of an hour, rounds of six.
SPARSE = TimeScale().scaled(720.0)


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)
