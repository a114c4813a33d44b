"""Live alerts as Structured Streaming jobs over landed snapshots."""
