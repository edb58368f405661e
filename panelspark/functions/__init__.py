from . import scalars, stats_dist

__all__ = ["scalars", "stats_dist"]
