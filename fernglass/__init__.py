"""fernglass: code search, code-graph and corpus analytics as Spark plans."""
