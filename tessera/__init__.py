"""Tessera: retrieval, review and corpus analytics expressed as Spark DataFrame plans."""
