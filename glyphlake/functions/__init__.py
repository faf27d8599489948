"""Column functions and grouped NumPy kernels."""
