"""Place directories and weekly schedules as Spark DataFrame jobs."""
