from . import aggregates, clean, extracts, joins, panel, reshape

__all__ = ["aggregates", "clean", "extracts", "joins", "panel", "reshape"]
