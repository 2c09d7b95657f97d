"""answerloom: multiple-choice benchmark analytics as Spark DataFrame jobs."""
