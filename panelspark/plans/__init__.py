from . import cross_section, ingest, panels, suites

__all__ = ["cross_section", "ingest", "panels", "suites"]
