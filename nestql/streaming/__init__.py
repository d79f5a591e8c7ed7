"""Streams: topics of files or Kafka, decoded, and delivered batch by batch."""

from nestql.streaming.streams import deliver, file_stream, run_available, windowed_counts

__all__ = ["deliver", "file_stream", "run_available", "windowed_counts"]
