"""Column builders: pure expressions that stay on the JVM side."""
