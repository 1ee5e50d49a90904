"""Column functions, kernels over bytes, and parsers of small specifications."""
