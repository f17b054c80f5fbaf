"""plumbline: compare two datasets or schemas with Spark and plan how to bring one in line with the other."""
