"""driftaudit: lineage and drift audits of vector indexes, as Spark DataFrame plans."""

__version__ = "0.1.0"
