"""Column-to-column helpers; everything here stays inside whole-stage codegen unless stated."""
