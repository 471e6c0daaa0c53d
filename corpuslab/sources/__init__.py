"""corpuslab.sources."""
