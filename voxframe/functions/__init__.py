"""Column functions, fixed value tables and numeric kernels."""
