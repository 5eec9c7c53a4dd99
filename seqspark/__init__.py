"""seqspark: sequence analytics as Spark DataFrame operators."""
