"""Column functions: everything here returns Spark columns and stays inside the JVM."""
