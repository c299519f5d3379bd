"""Column functions: each takes and returns Columns, and runs inside the JVM unless it says otherwise."""
