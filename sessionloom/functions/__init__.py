"""Column functions; all but diff and wire run inside the JVM."""
