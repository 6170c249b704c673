"""Filter design and NumPy kernels."""
