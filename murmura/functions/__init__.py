"""Scalar and array functions: Column -> Column."""
