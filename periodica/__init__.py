"""Statistics kept per entity, period and group, as Spark DataFrame operators."""
