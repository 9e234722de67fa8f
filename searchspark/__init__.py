"""searchspark: keeping document collections indexed and searchable with Spark."""
