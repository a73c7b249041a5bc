"""Point files as data sources and sinks."""
