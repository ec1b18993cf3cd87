"""Nothing outside the subpackage imports it."""

import pathlib
import re


def test_no_import_from_outside():
    root = pathlib.Path(__file__).resolve().parents[2]
    files = [p for p in (root / "lotwerk").rglob("*.py") if "llm" not in p.relative_to(root / "lotwerk").parts]
    assert files and not [p for p in files if re.search(r"lotwerk\.llm|from \.+llm", p.read_text())]


def test_every_problem_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} | {"p9_mix"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
