"""Call-signal analytics on Spark: signals, detector scores, verdicts and their evaluation."""
