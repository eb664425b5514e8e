"""driftgrid: aligned daily time-series tables, built and checked as Spark DataFrame plans."""
