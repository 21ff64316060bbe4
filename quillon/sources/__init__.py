"""Sources, sinks and providers of outside services."""
