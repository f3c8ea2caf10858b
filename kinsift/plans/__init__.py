"""The pipeline over all stages, its command line, and the registered queries."""
