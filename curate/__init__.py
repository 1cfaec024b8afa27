"""Rule-driven table cleaning, quality checks, matching and modelling on Spark."""
