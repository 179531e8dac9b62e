"""Whole-array versions that the tests hold the operators against."""

import numpy as np


def analytic_magnitude(values: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of a whole series."""
    n = len(values)
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    return np.abs(np.fft.ifft(np.fft.fft(values) * gain))


# Mask geometry: everything follows from how many pixels of a class each row and column holds ------
