"""corpuslab.operators."""
