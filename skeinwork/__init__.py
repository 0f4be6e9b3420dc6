"""skeinwork: a Spark-first relational algebra and scalar library."""
