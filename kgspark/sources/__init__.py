"""Sources and sinks: notes, extractions, logs, embedding collections, versioned tables."""
