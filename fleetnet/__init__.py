"""fleetnet: fleets on road and rail networks, as Spark DataFrames."""
