"""Column expressions. All of them stay in the JVM; there is no Python function in any plan."""
