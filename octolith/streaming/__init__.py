"""The incremental build."""
