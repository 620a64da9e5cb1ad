"""quire: document-intelligence analytics expressed as Spark DataFrame plans."""
