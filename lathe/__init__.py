"""A PySpark library for evaluating text-rewriting systems with perturbation probes, and for preparing text corpora."""
