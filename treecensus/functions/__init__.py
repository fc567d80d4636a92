"""Column expressions; every one is native and stays inside whole-stage code."""
