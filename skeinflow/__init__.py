"""skeinflow: content analytics on Spark, as DataFrame-to-DataFrame operators."""
