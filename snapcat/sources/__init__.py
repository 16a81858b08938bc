"""Sources and sinks: file trees, archives, and the catalog's own files."""
