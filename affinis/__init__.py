"""Survey-weighted association graphs and motif analytics as Spark DataFrame operators."""
