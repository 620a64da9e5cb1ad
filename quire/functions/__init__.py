"""quire."""
