"""loomtab: tabular machine-learning preparation and modelling as Spark jobs."""
