"""Sources, sinks and tables in a shared folder."""
