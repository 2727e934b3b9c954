"""Whole-table operators."""
