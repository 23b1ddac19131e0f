"""The engine over a directory of files."""

import pytest

from ferrograph.engine import Engine, table
from ferrograph.operators import query
from ferrograph.schema import InvalidArgument


def test_build_ask_edit_and_refresh(spark, tmp_path):
    root = tmp_path / "project"
    (root / "m").mkdir(parents=True)
    (root / "settings.gradle").write_text("rootProject.name = 'demo'")
    (root / "m" / "build.gradle").write_text("dependencies { implementation 'g:a:1' }")
    (root / "m" / "A.java").write_text("package p;\npublic class A extends B {\n  void go() { help(1); }\n}\n")
    (root / "m" / "B.java").write_text("package p;\npublic class B {\n  void help(int x) {}\n}\n")
    engine = Engine(spark, str(root), f"file://{tmp_path}/index")
    assert engine.rebuild() == 0
    assert [r.fqn for r in engine.query('{"command": "ls", "fqn": "p.B"}').collect()] == ["p.B#help(int)"]
    assert [(r.start_line, r.start_col) for r in engine.find_references("p.B#help(int)").collect()] == [(2, 14)]
    assert engine.resolve_symbol_at(f"{root}/m/A.java", 2, 15) == "p.B#help(int)"
    assert [r.fqn for r in engine.find_implementations("p.B").collect()] == ["p.A"]
    assert "p.A" in table(query.find(engine.graph, "^p.A$")) and engine.get_completion_candidates("p.B#") == ["p.B#help(int)"]
    assert engine.query({"command": "cat", "fqn": "dep:g:a:1"}).count() == 1
    with pytest.raises(InvalidArgument):
        engine.query({"command": "drop"})
    assert engine.refresh() == 0
    (root / "m" / "B.java").unlink()
    assert engine.refresh() == 1 and engine.query({"command": "cat", "fqn": "p.B#help(int)"}).count() == 0
    assert engine.query({"command": "cat", "fqn": "p.B"}).first()["status"] == "unresolved"
    engine.clear_index()
    assert not engine.load()
