"""Column functions; all run inside the JVM unless a module says otherwise."""
