"""Imports every module that registers queries."""

from starling.plans import integrity, queries_01_20, queries_21_45, queries_46_72, queries_73_99, refresh, shapes, staged, variants  # noqa: F401
