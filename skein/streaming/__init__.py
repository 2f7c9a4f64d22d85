"""Structured Streaming: documents that arrive are chunked and embedded once, and again only when their text changes."""
