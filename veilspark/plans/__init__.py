"""Sessions, end-to-end flows and the registered query suite."""
