"""NumPy kernels: recurrences and fits that no column expression states. None of them imports Spark."""
