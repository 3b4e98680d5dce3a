"""duopanel: two-sided (worker-firm) panel analytics on Spark DataFrames.

Importing the package keeps BLAS to one thread in this process: tasks already fill the cores, and threaded kernels may stall beside the JVM.
"""

from __future__ import annotations

import ctypes
import os
import sys

__version__ = "0.1.0"


def _one_thread() -> None:
    """By the environment if numpy is still to be loaded (and for processes started from here), else by the loaded library itself."""
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    if "numpy" not in sys.modules or not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as f:
        loaded = {line.split()[-1] for line in f if "openblas" in line}
    for path in loaded:
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(path), name)(ctypes.c_int(1))
                break
            except (AttributeError, OSError):  # built under another name
                continue


_one_thread()
