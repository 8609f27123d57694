"""DataFrame -> DataFrame operators of the coding workflow."""
