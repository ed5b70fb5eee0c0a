"""skein: log and message analytics as Spark DataFrame programs."""
