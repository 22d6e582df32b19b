"""Token-usage and cost analytics for coding-agent logs, written as Spark DataFrame jobs."""
