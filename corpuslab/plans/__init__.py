"""corpuslab.plans."""
