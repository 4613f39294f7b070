"""scaleloom: multiscale analytics of ordered event data on Spark."""
