"""Extraction and resolution on small sources."""

from pyspark.sql import functions as F

from graphloom.functions import extract
from graphloom.operators import ingest, intel
from graphloom.sources import repository

FILES = {
    "src/pay.ts": "import { log } from './log';\nimport fs from 'fs';\n\nexport class Pay extends Base {\n  run() { helper(); }\n}\nexport function helper() { log(1); }\nconst go = async (x) => x;\n",
    "src/log.ts": "export function log(x) {}\nexport class Base {}\n",
    "src/pay.spec.ts": "import { helper } from './pay';\ndescribe('x', () => { it('y', () => helper()); });\n",
    "app/main.py": "from .util import tool\nimport os\nclass A(B):\n    def run(self):\n        os.system('node ../src/pay.ts')\n\ndef top():\n    tool()\n",
    "app/util.py": "def tool():\n    pass\n",
    "app/util.go": 'package app\n\nimport "fmt"\n\ntype T struct {}\n\nfunc (t T) Do() { Run() }\nfunc Run() {}\n',
    "lib/M.java": "import app.Util;\npublic class M extends N {\n  public void go(int a) { }\n}\n",
    "lib/r.rs": "use crate::x::Y;\npub struct S;\nimpl Tr for S {}\npub fn f() {}\n",
    "lib/p.php": "<?php\nuse App\\X;\nclass P extends Q { function m() {} }\n",
    "lib/c.cs": "using System.Text;\npublic class C : D {\n  public void M() { }\n}\n",
    "node_modules/x.ts": "class No {}",
    "README.md": "text",
    "empty.ts": "",
}


def write(tmp_path):
    for path, text in FILES.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_repository(spark, tmp_path):
    write(tmp_path)
    files = repository.files(spark, str(tmp_path)).cache()
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == set(FILES) - {"node_modules/x.ts", "empty.ts"}
    assert rows["src/pay.spec.ts"]["category"] == "TEST" and rows["README.md"]["category"] == "SOURCE" and rows["lib/c.cs"]["language"] == "C#"

    symbols = extract.symbols(files).cache()
    found = {(r["path"], r["kind"], r["name"]): r["line"] for r in symbols.collect()}
    assert found["src/pay.ts", "class", "Pay"] == 4 and found["src/pay.ts", "function", "helper"] == 7 and found["src/pay.ts", "function", "go"] == 8
    assert found["app/main.py", "class", "A"] == 3 and found["app/main.py", "function", "top"] == 7
    assert {("app/util.go", "struct", "T"), ("app/util.go", "function", "Do"), ("lib/M.java", "class", "M"), ("lib/M.java", "function", "go"), ("lib/r.rs", "struct", "S"), ("lib/r.rs", "function", "f"), ("lib/p.php", "class", "P"), ("lib/c.cs", "class", "C"), ("lib/c.cs", "function", "M")} <= set(found)

    imports = extract.imports(files)
    assert {("src/pay.ts", "./log"), ("app/main.py", ".util"), ("app/util.go", "fmt"), ("lib/M.java", "app.Util"), ("lib/r.rs", "crate::x::Y"), ("lib/c.cs", "System.Text")} <= {(r["path"], r["target"]) for r in imports.collect()}
    resolved = ingest.resolve_imports(imports, files).cache()
    assert {(r["path"], r["to"]) for r in resolved.collect()} == {("src/pay.ts", "src/log.ts"), ("src/pay.spec.ts", "src/pay.ts"), ("app/main.py", "app/util.py")}

    calls = {(r["path"], r["name"]): r["to"] for r in ingest.resolve_calls(extract.calls(files), symbols, resolved).collect()}
    assert calls["src/pay.ts", "helper"] == "fn:src/pay.ts:helper" and calls["src/pay.ts", "log"] == "fn:src/log.ts:log" and calls["app/main.py", "tool"] == "fn:app/util.py:tool"
    strict = {(r["path"], r["name"]) for r in ingest.resolve_calls(extract.calls(files), symbols, resolved, strict=True).collect()}
    assert ("src/pay.ts", "log") not in strict

    parents = {tuple(r) for r in ingest.resolve_parents(extract.heritage(files), symbols, resolved).collect()}
    assert ("fn:src/pay.ts:Pay", "fn:src/log.ts:Base") in parents
    pairs, edges = ingest.match_tests(files, symbols)
    assert {tuple(r) for r in pairs.collect()} == {("src/pay.spec.ts", "src/pay.ts")} and edges.count() == 2
    assert {(r["src"], r["dst"]) for r in ingest.cross_language(files).collect()} == {("app/main.py", "src/pay.ts")}
    assert {tuple(r) for r in ingest.shared_names(files).collect()} == {("app/util.go", "app/util.py")}
    nodes, contains = ingest.directories(files)
    assert {r["id"] for r in nodes.collect()} == {"dir:src", "dir:app", "dir:lib"} and contains.count() == 3 + len(rows)
    assert ingest.file_nodes(files).where("extension = 'ts'").count() == 3


def test_references_across_languages(spark):
    """Each kind of reference, over line ends too; not to files of the same language, unknown ones, or plain mentions."""
    rows = [
        ("src/run.ts", "TypeScript", "import x;\nexecSync('python scripts/process.py');\nspawn('node',\n  ['tools/build.js']);\nconst s = `ruby lib/a.rb`;\n// see scripts/other.py"),
        ("src/orch.py", "Python", "import subprocess\nsubprocess.run(['node', 'tools/build.js'])\nos.system('go run cmd/server.go')\nx = 'bin/tool.js'\nPopen(['python', 'scripts/process.py'])"),
        ("cmd/server.go", "Go", 'func f() { exec.Command("python", "scripts/process.py") }\nvar p = "scripts/other.py"'),
        ("src/m.rs", "Rust", 'Command::new("python").arg("scripts/process.py")'),
        ("src/M.java", "Java", 'Runtime.getRuntime().exec("python scripts/process.py");\nnew ProcessBuilder("node", "tools/build.js");'),
        ("src/p.php", "PHP", "shell_exec('python scripts/process.py');"),
        ("src/c.cs", "C#", 'Process.Start("python", "scripts/process.py");'),
        ("Makefile", "Unknown", "all:\n\tpython scripts/process.py\n\t./bin/tool.js\n\tbash ops/deploy.sh"),
        ("src/sh.ts", "TypeScript", "const cmd = '../ops/deploy.sh'"),
        *((p, lang, "") for p, lang in [("scripts/process.py", "Python"), ("scripts/other.py", "Python"), ("tools/build.js", "JavaScript"), ("bin/tool.js", "JavaScript"), ("lib/a.rb", "Ruby"), ("ops/deploy.sh", "Shell")]),
        ("src/none.ts", "TypeScript", None),
    ]
    got = {(r["src"], r["dst"]): (r["reason"], r["line"]) for r in ingest.cross_language(spark.createDataFrame(rows, "path string, language string, content string")).collect()}
    assert got == {
        ("src/run.ts", "scripts/process.py"): ("exec", 2), ("src/run.ts", "tools/build.js"): ("spawn", 4), ("src/run.ts", "lib/a.rb"): ("script in a string", 5),
        ("src/orch.py", "tools/build.js"): ("subprocess", 2), ("src/orch.py", "cmd/server.go"): ("os.system", 3), ("src/orch.py", "bin/tool.js"): ("script path", 4),
        ("cmd/server.go", "scripts/process.py"): ("exec.Command", 1), ("cmd/server.go", "scripts/other.py"): ("script path", 2), ("src/m.rs", "scripts/process.py"): ("Command", 1),
        ("src/M.java", "scripts/process.py"): ("Runtime.exec", 1), ("src/M.java", "tools/build.js"): ("ProcessBuilder", 2), ("src/p.php", "scripts/process.py"): ("shell", 1), ("src/c.cs", "scripts/process.py"): ("Process.Start", 1),
        ("Makefile", "scripts/process.py"): ("build file", 2), ("Makefile", "bin/tool.js"): ("build file", 3), ("Makefile", "ops/deploy.sh"): ("build file", 4), ("src/sh.ts", "ops/deploy.sh"): ("shell script", 1),
    }


def test_files_that_hold_no_code(spark):
    no = ["a/x.test.ts", "x.spec.py", "package.json", "a/Dockerfile", ".env", "a/.env.local", ".prettierrc.json", ".eslintrc", "tsconfig.json", "tsconfig.base.json", "jest.config.mjs", "README.md", "a/logo.SVG", "go.sum", "types/x.d.ts", "yarn.lock"]
    yes = ["a/x.ts", "src/environment.ts", "testing.py", "a/config.ts", "d.ts", "my.package.json5", "latest/test/x.go", "sitemap.ts"]
    df = spark.createDataFrame([(x,) for x in [*no, *yes, None]], "path string")
    got = {r["path"] for r in df.where(intel.code_only(F.col("path"))).collect()}
    assert got == {*yes, None}


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",), ("a//b/",)], "p string")
    assert [r[0] for r in df.select(ingest.normal(F.col("p"))).collect()] == ["a/c", None, None, "a/b"]


def test_change_set(spark):
    got = repository.change_set(spark, "A\tnew.ts\nM\ta.ts\nD\told.ts\nR090\tsrc/x.ts\tsrc/y.ts\n", "3\t0\tnew.ts\n1\t2\ta.ts\n-\t-\told.ts\n5\t1\tsrc/{x.ts => y.ts}\n")
    assert {tuple(r) for r in got.collect()} == {("new.ts", None, "ADDED", 3, 0), ("a.ts", None, "MODIFIED", 1, 2), ("old.ts", None, "DELETED", 0, 0), ("src/y.ts", "src/x.ts", "RENAMED", 5, 1)}
