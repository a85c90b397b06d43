"""Model files on the driver: pins, store, installer, rollback; text sources and sinks."""
