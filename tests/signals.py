"""Signals for tests."""

import numpy as np


def voice(rng: np.random.Generator, seconds: float = 2.0, rate: int = 16000) -> np.ndarray:
    """Harmonics of a gliding tone, weaker with their number, in syllables of a third of a second, with a little noise."""
    n = int(seconds * rate)
    t = np.arange(n) / rate
    pitch = rng.uniform(105, 190) * (1 + 0.06 * np.sin(2 * np.pi * rng.uniform(0.3, 0.7) * t + rng.uniform(0, 6)))
    phase, peak = 2 * np.pi * np.cumsum(pitch) / rate, rng.uniform(500, 900)
    x = sum(np.exp(-abs(k * pitch - peak) / 900) * np.sin(k * phase + k * k) for k in range(1, 20))
    loud = 0.15 + np.abs(np.sin(np.pi * 3 * t)) ** 0.7
    return 0.35 * x * loud / max(1e-9, np.abs(x * loud).max(initial=0.0)) + 0.0005 * rng.standard_normal(n)
