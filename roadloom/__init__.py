"""Trajectories, road graphs and facility placement as Spark jobs."""
