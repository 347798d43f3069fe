"""Column functions: built-in expressions only, so plans stay on the JVM side."""
