"""Incremental work: idempotent upserts from a stream, bounded ingest, and (as extensions) event-time windows."""
