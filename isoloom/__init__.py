"""isoloom: long-read clustering and isoform detection as Spark dataflows."""

__version__ = "0.1.0"
