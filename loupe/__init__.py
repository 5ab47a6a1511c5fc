"""loupe — product-review analytics expressed as Spark DataFrame plans.

Pipeline: page snapshots -> page facts (one Arrow stage) -> typed product and
review tables -> dedup / merge / resume -> per-product summaries -> serving
views and JSON exports, in batch or as incremental streaming jobs.
"""

__version__ = "0.1.0"
