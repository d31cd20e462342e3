"""Every registered query of the match and odds operators, with its SQL counterpart."""

from __future__ import annotations

from oddslake.plans import games, graph, grouped, history, identity, joined, late, listings, names, ordered, phases, provision, revisions, scalar, windows

_ALL = ordered.QUERIES | joined.QUERIES | grouped.QUERIES | scalar.QUERIES | history.QUERIES | identity.QUERIES | games.QUERIES | windows.QUERIES | names.QUERIES | late.QUERIES | graph.QUERIES | revisions.QUERIES | listings.QUERIES | provision.QUERIES | phases.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
