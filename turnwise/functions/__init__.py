"""Column-level functions: Column in, Column out, no Python UDFs."""
