"""Streams: sources, watermarks, state and sinks around the batch operators."""
