"""SQL twins of the named queries, for an engine that knows ANSI SQL and lists."""

from tidewheel.plans import checks, evaluations, graphs, markets, mines, panels, profiles, reports, rollups, series, shapes, trials

ORACLES = {k: q for m in (panels, profiles, evaluations, mines, markets, graphs, rollups, shapes, trials, series, reports, checks) for k, q in m.ORACLES.items()}
