"""auditloom: provenance and catalog audit as declarative Spark plans."""
