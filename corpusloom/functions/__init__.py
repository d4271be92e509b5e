"""Column expressions: everything here stays on the JVM unless its name says otherwise."""
