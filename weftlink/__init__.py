"""weftlink: link health and page content analytics over page snapshots, on Spark."""

__version__ = "0.1.0"
