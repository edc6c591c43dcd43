"""Column expressions. All of them stay inside the JVM."""
