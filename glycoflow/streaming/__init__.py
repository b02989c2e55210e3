"""The live detection loop on Structured Streaming."""
