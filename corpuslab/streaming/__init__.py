"""corpuslab.streaming."""
