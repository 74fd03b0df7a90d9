"""timberline: log triage and text-corpus preparation expressed as Spark DataFrame jobs."""
