"""lexloom: document chunking, hybrid retrieval and grounding audits as Spark plans."""

__version__ = "0.1.0"
