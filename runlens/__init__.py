"""runlens: DataFrame-in, DataFrame-out operators for experiment sweeps on Spark."""
