"""Scalar and array functions: numpy kernels for whole maps and column expressions for vectors."""
