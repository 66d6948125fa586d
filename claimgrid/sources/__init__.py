"""Table readers, CSV loaders, sinks and the views over the driver tables."""
