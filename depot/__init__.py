"""Analytics over fleets of software environments, as Spark DataFrame jobs."""
