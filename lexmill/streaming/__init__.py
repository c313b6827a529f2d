"""Structured Streaming: classification of streams and incremental learning."""
