import json
from dataclasses import dataclass, field

from lithoscope.sources import scan
from lithoscope.sources.extract import extract, extract_symbols
from lithoscope.sources.ignore import glob_to_regex, ignored_paths, is_ignored, parse_rule, parse_rules


def test_rule_kinds():
    kinds = {"foo.txt": "exact", "*.pyc": "suffix", "build*": "prefix", "*node*": "contains", "a/**/b": "regexp", "foo?.txt": "regexp", "[abc].txt": "regexp"}
    assert {g: parse_rule(g).kind for g in kinds} == kinds
    assert glob_to_regex("a/**/b.*") == r"^a/.*/b\.[^/]*$" and parse_rule("# x") is None and parse_rule("!x") is None and parse_rule(" ") is None


def test_matching(spark):
    rules = parse_rules("build/\n*.PYC\nsrc/gen*\n/lead\n")
    cases = {"build/a.py": True, "x/build/a.py": True, "build": False, "a.pyc": True, "src/gen1/x": True, "lead": False, "src/main.py": False}
    assert {p: is_ignored(p, rules) for p in cases} == cases
    paths = spark.createDataFrame([(f"/r/{p}",) for p in cases] + [("/q/a.pyc",)], "path string")
    table = spark.createDataFrame([("/r", line) for line in ("build/", "*.PYC", "src/gen*", "/lead", "", "#x")], "dir string, line string")
    got = {r["path"] for r in ignored_paths(paths, table).collect()}
    assert got == {f"/r/{p}" for p, v in cases.items() if v}


def test_scan_respects_ignore_files_and_nested_trees(spark, tmp_path):
    for p, t in {"a.py": "x = 1", "b.log": "l", ".gitignore": "*.log\n", "sub/c.log": "l", "sub/.gitignore": "d.py\n", "sub/d.py": "y", "tree/.git": "gitdir: x", "tree/e.py": "z"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True, parents=True)
        f.write_text(t)
    files = scan.without_ignored(scan.scan_tree(spark, str(tmp_path)))
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in files.collect()) == ["/a.py"]


def test_extractors(spark):
    py = b'class A:\n    X = 1\n    @staticmethod\n    def m(a, b=(1, 2)):\n        """Doc."""\n        return helper(a).go()\n\ndef f():\n    pass\nY = 2\n'
    got = {s.name: s for s in extract("p/a.py", py)}
    assert {n: s.kind for n, s in got.items()} == {"a.A": "class", "a.A.X": "variable", "a.A.m": "method", "a.f": "function", "a.Y": "variable"}
    assert got["a.A.m"].calls == ["go", "helper"] and got["a.A.m"].params == "a, b=(1, 2)" and got["a.A.m"].depth == 1
    go = b"package p\n// func no() {\nfunc (s *Srv) Run(a int, b string) error {\n\ts.log(a)\n\treturn nil\n}\ntype Srv struct {\n\tx int\n}\n"
    got = {s.name: (s.kind, s.line, s.end_line, s.calls) for s in extract("a.go", go)}
    assert got == {"p.Srv.Run": ("method", 3, 6, ["log"]), "p.Srv": ("type", 7, 9, [])}
    cs = b"public class Box {\n  private static int Add(int a, List<int, int> b) {\n    return Sum(a);\n  }\n}\n"
    got = {s.name: (s.kind, s.tags, s.calls) for s in extract("a.cs", cs)}
    assert got["Box.Add"] == ("method", {"is_static": "true", "visibility": "private"}, ["Sum"])
    js = b"export class K {\n  go(a) {\n    if (a) { run(a); }\n  }\n}\nfunction f() {\n}\n"
    assert {s.name: s.kind for s in extract("a.tsx", js)} == {"K": "class", "K.go": "method", "f": "function"}
    c = b'static int add(int a, char *b) {\n  return g("x(", a);\n}\nstruct P {\n  int x;\n};\n'
    assert {s.name: (s.kind, s.calls) for s in extract("a.c", c)} == {"add": ("function", ["g"]), "P": ("struct", [])}
    pkg = json.dumps({"name": "n", "displayName": "N", "description": "d", "keywords": ["k"]}).encode()
    assert [(s.name, s.snippet) for s in extract("x/package.json", pkg)] == [("N", "package: n\nd\nkeywords: k")]
    y = b"job1:\n  name: build\n  dependencies: [a]\nkey: " + b"v" * 90
    assert [(s.name, s.kind) for s in extract("ci.yml", y)] == [("build", "job"), ("key", "config-key")]
    assert extract("a.py", b"def (") == [] and extract("a.bin", b"") == [] and extract("a.py", None) == []
    df = extract_symbols(spark.createDataFrame([("a.go", bytearray(go)), ("b.txt", bytearray(b"x")), ("c.py", None)], "path string, content binary"))
    assert {(r["name"], r["param_count"]) for r in df.collect()} == {("p.Srv.Run", 2), ("p.Srv", 0)}


def test_declarations_of_each_language():
    got = lambda path, text: [(s.name, s.kind, s.line, s.end_line, s.params, s.depth, s.tags.get("visibility"), s.tags.get("is_static")) for s in extract(path, text.encode())]
    cs = "namespace Yard.Tools;\npublic class Crane : Base<int>\n{\n  private readonly List<int> loads = new List<int> {\n    1, 2 };\n  public static int Count;\n  public string Name { get; set; }\n  public int Twice => Count * 2;\n  public Crane(int a) : base(a)\n  {\n    var x = Make(a);\n    int y = 3;\n    return Foo(x);\n  }\n  protected internal int F(int  a) => G(a);\n  interface IHook\n  {\n    void Do(int a);\n  }\n}\nenum E { A, B }\n"
    c = "Yard.Tools.Crane"
    assert got("b.cs", cs) == [
        (c, "class", 2, 20, "", 0, "public", None), (f"{c}.loads", "field", 4, 5, "", 1, "private", None), (f"{c}.Count", "field", 6, 6, "", 1, "public", "true"), (f"{c}.Name", "field", 7, 7, "", 1, "public", None),
        (f"{c}.Twice", "field", 8, 8, "", 1, "public", None), (f"{c}.Crane", "method", 9, 14, "int a", 1, "public", None), (f"{c}.F", "method", 15, 15, "int a", 1, "protected internal", None),
        (f"{c}.IHook", "interface", 16, 19, "", 1, None, None), (f"{c}.IHook.Do", "method", 18, 18, "int a", 2, None, None), ("Yard.Tools.E", "enum", 21, 21, "", 0, None, None),
    ]
    assert {s.name: s.calls for s in extract("b.cs", cs.encode())}[f"{c}.F"] == ["G"]
    assert [x[:5] for x in got("b.c", "static int count = 3;\nint *p = 0;\nint a[3] = {1};\nstruct P {\n  int x;\n};\nenum Q { A };\nstatic int add(int a,\n   int b) {\n  int c = a;\n  return c;\n}\n")] == [("count", "variable", 1, 1, ""), ("P", "struct", 4, 6, ""), ("add", "function", 8, 12, "int a, int b")]
    assert [x[:3] for x in got("b.fx", "int q = 1;\nfloat4 main(float2 uv) {\n  return f(uv);\n}\n")] == [("main", "function", 2)]
    assert [x[:3] for x in got("b.go", "package q\n\nconst (\n\tA = 1\n\tB\n)\nvar z = 3\ntype I interface {\n\tDo()\n}\ntype M map[string]int\n")] == [("q.A", "variable", 4), ("q.B", "variable", 5), ("q.z", "variable", 7), ("q.I", "type", 8), ("q.M", "type", 11)]
    py = "import x\nif x:\n    def inner():\n        pass\n    Q = 1\nA: int = 3\nb = c = 1\nd, e = 1, 2\nclass K(object):\n    __slots__ = ()\n    @property\n    def __init__(self, a: dict = {'(': 1},\n                 *b, **c):\n        def nest(): pass\n        z = 1\n"
    assert got("b.py", py) == [("b.inner", "function", 3, 4, "", 0, "public", None), ("b.A", "variable", 6, 6, "", 0, "public", None), ("b.b", "variable", 7, 7, "", 0, "public", None), ("b.K", "class", 9, 15, "", 0, "public", None), ("b.K.__slots__", "variable", 10, 10, "", 1, "private", None), ("b.K.__init__", "method", 12, 15, "self, a: dict = {'(': 1}, *b, **c", 1, "private", None), ("b.K.nest", "function", 14, 14, "", 2, "public", None)]
    assert extract("b.py", py.encode())[5].snippet.startswith("def __init__")
    assert [x[:2] for x in got("b.js", "export const a = 1;\nconst q = 2;\ninterface X { y: 1 }\n")] == [("q", "variable")]


def test_callees_get_full_names():
    calls = lambda path, text: {s.name: s.calls for s in extract(path, text.encode()) if s.kind in ("function", "method")}
    go = (
        "package mill\n\ntype Press struct {\n\tplates int\n}\n\ntype Ledger struct{}\n\n"
        "func (p *Press) Squeeze(n int) int {\n\tif n > p.plates {\n\t\treturn p.Fold(n)\n\t}\n\treturn Weigh(n)\n}\n\n"
        "func (p *Press) Fold(n int) int { return Weigh(n / 2) }\n\n"
        "func (l Ledger) Fold(n int) int { return l.Total() + n }\n\nfunc (l Ledger) Total() int { return 0 }\n\nfunc Weigh(n int) int { return n }\n"
    )
    got = calls("mill.go", go)
    assert got == {"mill.Press.Squeeze": ["mill.Press.Fold", "mill.Weigh"], "mill.Press.Fold": ["mill.Weigh"], "mill.Ledger.Fold": ["mill.Ledger.Total"], "mill.Ledger.Total": [], "mill.Weigh": []}
    cs = (
        "namespace Harbour.Cranes\n{\n  public class Winch\n  {\n    private Rope line = null;\n    private Motor drive;\n"
        "    public void Lift(int load)\n    {\n      drive.Start(load);\n      line.Wind(Length(load));\n    }\n"
        "    public int Length(int load)\n    {\n      return load * 3;\n    }\n  }\n"
        "  public class Rope\n  {\n    public void Wind(int n)\n    {\n    }\n    public void Start(int n)\n    {\n    }\n  }\n"
        "  public class Motor\n  {\n    public void Start(int n)\n    {\n    }\n  }\n}\n"
    )
    got = calls("winch.cs", cs)
    assert got["Harbour.Cranes.Winch.Lift"] == ["Harbour.Cranes.Motor.Start", "Harbour.Cranes.Rope.Wind", "Harbour.Cranes.Winch.Length"] and got["Harbour.Cranes.Winch.Length"] == []
    py = "class S:\n    def a(self):\n        self.b()\n        def inner():\n            free()\n    def b(self):\n        return b\ndef free():\n    free()\n"
    got = calls("m.py", py)
    assert got == {"m.S.a": ["m.S.b", "m.free"], "m.S.inner": [], "m.S.b": [], "m.free": []}
    js = "class K {\n  go() {\n    this.stop();\n  }\n  stop() {\n  }\n}\n"
    assert calls("x.js", js)["K.go"] == ["K.stop"]


def test_git_and_roots(spark):
    lines = spark.createDataFrame([("a", "abc|Ann B|HEAD -> main, origin/main"), ("b", "broken")], "path string, line string")
    assert [tuple(r) for r in scan.git_log(lines).collect()] == [("a", "abc", "Ann B", "main")]
    p = spark.createDataFrame([("/r/s/x.py",), ("/r/y.py",), ("/z.py",)], "path string")
    roots = spark.createDataFrame([("/r",), ("/r/s",)], "root string")
    assert {tuple(r) for r in scan.common_roots(p, roots).collect()} == {("/r/s/x.py", "/r/s", "x.py"), ("/r/y.py", "/r", "y.py")}


def test_settings_and_transcripts(spark, tmp_path):
    @dataclass
    class Inner:
        n: int = 1
        s: str = "a"

    @dataclass
    class Conf:
        inner: Inner = field(default_factory=Inner)
        x: int = 0

    c = scan.merge_settings(Conf(), "x = 5\nunknown = 1\n[inner]\nn = 7\n")
    assert (c.x, c.inner.n, c.inner.s) == (5, 7, "a")
    (tmp_path / "t.jsonl").write_text('{"type": "user", "message": {"content": "hi"}}\nbroken{\n')
    assert [(r["type"], r["message"]) for r in scan.transcripts(spark, str(tmp_path)).collect()] == [("user", '{"content":"hi"}')]
    files = spark.createDataFrame([("p/.rules", bytearray(b'suppress = ["a", "b"]')), ("q/.rules", bytearray(b"= broken"))], "path string, content binary")
    assert {tuple(r) for r in scan.suppression_table(files).collect()} == {("p", "a"), ("p", "b")}


def test_large_files_are_hashed_by_their_bytes(spark, tmp_path):
    import hashlib

    for n in ("a.txt", "b.txt"):
        (tmp_path / n).write_bytes(b"x" * 3_000_000)
    (tmp_path / "c.txt").write_bytes(b"y")
    got = {r["path"].rsplit("/", 1)[-1]: (r["hash"], r["content"] is None) for r in scan.scan_tree(spark, str(tmp_path), max_bytes=1000).collect()}
    big = hashlib.sha1(b"x" * 3_000_000).hexdigest()
    assert got == {"a.txt": (big, True), "b.txt": (big, True), "c.txt": (hashlib.sha1(b"y").hexdigest(), False)}


def test_python_packages(spark):
    files = [("r/app/__init__.py", b""), ("r/app/core/__init__.py", b"X = 1"), ("r/app/core/io.py", b"def read():\n    return parse()\ndef parse():\n    return 1\n"), ("r/loose/a.py", b"def f():\n    pass\n"), ("r/app/none/b.py", b"def g():\n    pass\n"), ("__init__.py", b"Y = 1")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {r["name"]: r for r in extract_symbols(df).collect()}
    assert {"app.core.io.read", "app.core.io.parse", "a.f", "b.g", "app.core.__init__.X", "__init__.Y"} == set(got)
    assert got["app.core.io.read"]["calls"] == ["app.core.io.parse"] and got["app.core.io.read"]["tags"]["namespace"] == "app.core.io"


def test_git_is_asked_on_the_executors(spark, tmp_path):
    import shutil
    import subprocess

    import pytest

    if not shutil.which("git"):
        pytest.skip("no git")
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.txt").write_text("x")
    (tmp_path / "loose.txt").write_text("x")
    for args in (["init", "-q", "-b", "trunk"], ["add", "."], ["-c", "user.name=Ann B", "-c", "user.email=a@example.org", "commit", "-q", "-m", "m"]):
        subprocess.run(["git", "-C", str(tmp_path / "repo"), *args], check=True)
    paths = spark.createDataFrame([(str(tmp_path / "repo" / "a.txt"),), (str(tmp_path / "loose.txt"),), (None,)], "path string")
    got = scan.git_log(scan.read_git(paths)).collect()
    assert [(r["author"], r["branch"]) for r in got] == [("Ann B", "trunk")] and len(got[0]["commit"]) == 40
    known = spark.createDataFrame([(7, "/r/a", "u")], "id bigint, path string, url string")
    roots = spark.createDataFrame([("/r/a", "other"), ("/r/b", None), ("/r/b", "v")], "path string, url string")
    assert {(r["path"], r["url"]) for r in scan.upsert_repositories(known, roots).collect()} == {("/r/a", "u"), ("/r/b", "v")}


def test_analyzers_and_secrets():
    text = '[[analyzers]]\nname = "bugs"\nconfidence = 0.9\n[[analyzers.rules]]\nname = "leak"\n[[analyzers]]\nname = "style"\nfile_mode = true\n'
    a, b = scan.analyzers(text)
    assert a["confidence"] == 0.9 and a["rules"] == [{"name": "leak", "severity": "warning", "description": ""}] and b["file_mode"] and b["min_lines"] == 5 and scan.analyzers("") == []

    @dataclass
    class Service:
        api_key: str = ""

    @dataclass
    class Settings:
        first: Service = field(default_factory=Service)
        many: list = field(default_factory=lambda: [Service(), Service("own")])

    c = scan.fill_secrets(Settings(), '[llm]\napi_key = "s"')
    assert (c.first.api_key, [x.api_key for x in c.many]) == ("s", ["s", "own"])
    assert scan.fill_secrets(Settings(), "= broken").first.api_key == ""
