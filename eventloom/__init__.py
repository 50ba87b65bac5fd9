"""eventloom: event-calendar analytics expressed as Spark DataFrame operators."""
