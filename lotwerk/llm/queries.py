"""The subpackage's queries and their SQL."""

from lotwerk.llm import components, leaks, mapping, mixing, setjoin, truncation

_ALL = [mapping, setjoin, components, leaks, mixing, truncation]
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
