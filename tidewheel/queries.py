"""All named queries over the registered tables."""

from tidewheel.plans import checks, evaluations, graphs, markets, mines, panels, profiles, reports, rollups, series, shapes, trials

QUERIES = {k: f for m in (panels, profiles, evaluations, mines, markets, graphs, rollups, shapes, trials, series, reports, checks) for k, f in m.QUERIES.items()}
