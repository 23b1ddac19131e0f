"""Java and Gradle sources, from text to answers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from ferrograph.operators import assets, present, references
from ferrograph.sources import gradle, java

FILES = {
    "src/Base.java": "package app.core;\npublic class Base {\n  public static void hello() {}\n  protected int size;\n  public void run(int times) { size = times; }\n}\n",
    "src/Child.java": "package app.core;\nimport java.util.List;\nimport app.api.*;\n@Marked\npublic class Child extends Base implements Shape {\n  private List<Point> points;\n  public static void hello() {}\n  public void area(Point... ps) { run(3); for (Point p : ps) { p.move(1); } }\n  Child self() { return new Child(); }\n}\n",
    "src/Shape.java": "package app.api;\npublic interface Shape { void area(Point... ps); }\n",
    "src/Point.java": "package app.api;\npublic class Point {\n  public void move(int by) { if (by > 0) { move(by - 1); } }\n  enum Side { LEFT, RIGHT }\n}\n",
    "src/Use.java": "package app.use;\nimport app.core.Child;\nimport app.core.Base;\nimport app.api.Point;\nclass Use {\n  void go() {\n    Point point = new Point();\n    point.move(2);\n    Child.hello();\n    Base.hello();\n    new Child().run(1);\n  }\n  void broken( { ;\n}\n",
    "src/Marked.java": "package app.core;\npublic @interface Marked {}\n",
}


@pytest.fixture(scope="module")
def project(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    g = java.index(java.parse_files(files).checkpoint())
    for part in ("nodes", "edges", "tokens", "occurrences"):
        setattr(g, part, getattr(g, part).checkpoint())
    return g


def edges(g, kind):
    return {(r["src"], r["dst"]) for r in g.edges.filter(F.col("edge_type") == kind).collect()}


def test_edges_of_declarations(project):
    assert ("app.core.Child", "app.core.Base") in edges(project, "InheritsFrom")
    assert ("app.core.Child", "app.api.Shape") in edges(project, "Implements")
    assert ("app.core.Child", "app.core.Marked") in edges(project, "DecoratedBy")
    assert {("app.core.Child#points", "java.util.List"), ("app.core.Child#points", "app.api.Point")} <= edges(project, "TypedAs")
    assert {("app.core", "app.core.Child"), ("app.core.Child", "app.core.Child#area(Point[])"), ("app.api.Point.Side", "app.api.Point.Side#LEFT")} <= edges(project, "Contains")


def refs(spark, project, fqn, **more):
    got = references.find_references(project, spark.createDataFrame([(fqn,)], "fqn string"), **more).collect()
    return sorted((r.path.rsplit("/")[-1], r.start_line) for r in got)


def test_references(spark, project):
    assert refs(spark, project, "app.api.Point#move(int)") == [("Child.java", 7), ("Point.java", 2), ("Use.java", 7)]
    assert refs(spark, project, "app.core.Base#run(int)") == [("Child.java", 7), ("Use.java", 10)]
    assert ("Use.java", 6) in refs(spark, project, "app.api.Point")


def test_static_methods_are_told_apart_by_owner(spark, project):
    calls = project.occurrences.filter("token = 'hello' AND is_call").collect()
    assert {(r.start_line, r.resolved_fqn) for r in calls} == {(8, "app.core.Child#hello()"), (9, "app.core.Base#hello()")}


def test_call_hierarchy(spark, project):
    target = spark.createDataFrame([("app.api.Point#move(int)",)], "fqn string")
    assert {r.caller for r in references.incoming_calls(project, target).collect()} == {"app.core.Child#area(Point[])", "app.use.Use#go()"}
    assert "app.api.Point#move(int)" in {r.caller for r in references.incoming_calls(project, target, include_recursive=True).collect()}
    out = references.outgoing_calls(project, spark.createDataFrame([("app.core.Child#area(Point[])",)], "fqn string"))
    assert {r.callee for r in out.collect()} == {"app.core.Base#run(int)", "app.api.Point#move(int)"}


def test_shown_signatures(project):
    shown = {r.id: r.signature for r in present.display(project.nodes).collect()}
    assert shown["app.core.Child#area(Point[])"] == "area(ps: Point...) -> void" and shown["app.core.Child#points"] == "points: List<Point>"
    assert shown["app.core.Child"] == "class Child" and shown["app.api.Point.Side"] == "enum Side"


@pytest.mark.parametrize("text", ["", "class", "class A {", "class A { void f( }", "/* open", '"""x', "package ;;; import", "}}}}", "@", "class A { int x = ", "enum E {", "é ∆ class Ü { }", "class A<T extends B<T>> extends C<T { }"])
def test_broken_sources_are_stepped_over(text):
    java.parse(text)


def test_gradle(spark):
    files = spark.createDataFrame([
        ("settings.gradle", "rootProject.name = 'shop'\ninclude 'api', 'app:ui'\ninclude(\"x\")\n"),
        ("build.gradle", "dependencies { }"),
        ("api/build.gradle", "dependencies {\n  api 'g:a:1' // api 'no:no:1'\n  testImplementation(\"h:b:2\")\n  implementation 'bad:one'\n}"),
        ("app/ui/build.gradle.kts", "dependencies { implementation(project(\":api\")) }"),
    ], "path string, content string")
    nodes, links = gradle.project_graph(files)
    assert {r.fqn for r in nodes.collect()} == {"project:shop", "root", "api", "app/ui", "dep:g:a:1", "dep:h:b:2"}
    assert {(r.src, r.dst) for r in links.collect()} == {("project:shop", "root"), ("root", "api"), ("root", "app/ui"), ("api", "dep:g:a:1"), ("api", "dep:h:b:2"), ("app/ui", "api")}
    assert gradle.settings(files).first()["included_projects"] == ["api", "app:ui", "x"]


def test_assets(spark, tmp_path):
    for name in ("lib-1.jar", "lib-1-sources.jar"):
        place = tmp_path / "org.ex" / "lib" / "1" / "abc"
        place.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(place / name, "w") as z:
            for entry in ("org/ex/A.class", "org/ex/sub/B.class", "META-INF/x"):
                z.writestr(entry, "")
    (place / "bad-2.jar").write_text("no zip")
    found = assets.discovered(spark, str(tmp_path))
    assert {(r.group, r.artifact, r.version) for r in found.collect()} == {("org.ex", "lib", "1")} and found.count() == 2
    routes, counters = assets.scan(found)
    assert {r.prefix for r in routes.collect()} == {"org.ex", "org.ex.sub"}
    assert counters.select("total", "indexed", "failed", "prefixes").first() == (2, 1, 1, 2)
    assert assets.source_archives(found.filter("path LIKE '%lib-1.jar'"), spark.createDataFrame([(str(place / "lib-1-sources.jar"),)], "path string")).first()["sources_path"].endswith("sources.jar")
