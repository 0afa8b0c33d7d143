"""Mini-batch forms of encoding and codebook upkeep on Structured Streaming."""
