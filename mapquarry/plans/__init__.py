"""Whole-query plans: layers, the table adapter, the result cache."""
