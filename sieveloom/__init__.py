"""sieveloom: curation and statistics of defect-inspection datasets, expressed as Spark plans."""

__version__ = "0.1.0"
