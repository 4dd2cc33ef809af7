"""Record-linkage, deduplication and text-cleaning operators for training-data pipelines.

Nothing outside this subpackage imports it.
"""
