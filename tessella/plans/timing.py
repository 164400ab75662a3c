"""Best and mean wall time of repeated runs."""

from __future__ import annotations

import time
from collections.abc import Callable


def best_and_mean(run: Callable[[], object], times: int = 10) -> tuple[float, float]:
    """Seconds of the fastest of ``times`` runs and their mean."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took), sum(took) / len(took)
