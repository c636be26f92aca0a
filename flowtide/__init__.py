"""Flow analytics on Spark: host-window features, unsupervised ranking, pair history and reports."""
