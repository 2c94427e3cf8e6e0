"""Named queries over the corpus and their SQL."""

from . import argument, grounding, intervals, overlap, records, relational, rules, trace, voice

_MODULES = (overlap, voice, rules, argument, trace, grounding, records, intervals, relational)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
