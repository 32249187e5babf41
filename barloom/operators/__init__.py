"""``DataFrame -> DataFrame`` operators on bars, weights, equity and snapshots."""
