"""Streams: incremental ingestion with the same operators."""
