"""Operators for preparing training data: counts, fingerprints, deduplication, quality, mixing, packing.

Python functions of this package run inside tasks: executors need the package on their path
(installed, or shipped with ``--py-files``).
"""
