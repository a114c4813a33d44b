"""Column expressions; all but three run inside the JVM."""
