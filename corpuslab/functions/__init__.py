"""corpuslab.functions."""
