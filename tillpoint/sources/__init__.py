"""Sources, sinks and catalog listings."""
