"""trainlake: workout time series and text-corpus analytics as composable Spark DataFrame operators."""
