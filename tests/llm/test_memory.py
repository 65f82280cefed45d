import numpy as np

from cairnworks.llm import common


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_freed_arrays_go_back_to_the_system():
    """Blocks below the mapping threshold lie in the heap, where the last one holds all freed ones before it."""
    held = [np.ones(8000) for _ in range(4000)]  # 256 MB
    last = held[-1]
    full = resident_mb()
    del held
    common.release_memory()
    assert resident_mb() < full - 200 and last[0] == 1
