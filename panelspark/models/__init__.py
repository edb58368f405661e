from . import bygroup, engine, factors, grid, lasso, linear, spec, tables, wald

__all__ = ["bygroup", "engine", "factors", "grid", "lasso", "linear", "spec", "tables", "wald"]
