"""Profiles, ignore files of folders, imports over several lines, names of requests, parts of packs."""

import hashlib

from pyspark.sql import functions as F

from brackenlake.functions import paths
from brackenlake.operators import context, knowledge, structure
from brackenlake.plans import discovery
from brackenlake.sources import corpus

FILES = "repository_id string, path string, content string"


def test_profiles(spark):
    rows = [
        ("a", "Makefile", ""), ("a", "src/x.rs", ""), ("a", "docs/y.md", ""), ("a", "web/package.json", '{"scripts": {"test": "jest"}, "dependencies": {"vue": "3", "next": "1"}}'), ("a", "node_modules/go.mod", ""), ("a", "deep/er/go.mod", ""),
        ("b", "requirements.txt", ""), ("b", "Makefile", ""), ("b", "srv/build.gradle.kts", ""), ("c", "package.json", "not json"), ("d", "x.py", ""), ("e", "pyproject.toml", "[tool.uv]"), ("e", "pom.xml", ""), ("e", "build.gradle", ""),
    ]
    got = {r["repository_id"]: (r["folders"], r["frameworks"], r["build"], r["test"]) for r in discovery.profile(spark.createDataFrame(rows, FILES)).collect()}
    assert got["a"] == (["src", "docs"], ["make", "node", "vue", "next"], "make", "make test")
    assert got["b"] == ([], ["python", "make", "gradle"], "gradle build", "pytest")  # make comes after pytest and gives nothing
    assert got["c"][1:] == (["node"], None, "npm test") and got["d"][1:] == (None, None, None)
    assert got["e"][1:] == (["python", "uv", "maven"], "mvn package", "pytest")
    text = discovery.profile_json(discovery.profile(spark.createDataFrame(rows[-4:-3], FILES))).first()["profile"]
    assert '"language":"python","n":1' in text and '"build":null' in text


def test_ignore_files_of_folders(spark, tmp_path):
    root = tmp_path / "r"
    for name, text in {".gitignore": "*.log\n/out/\n", "a.log": "", "out/x.py": "", "sub/.gitignore": "!keep.log\nlocal.py\n", "sub/keep.log": "", "sub/local.py": "", "sub/deep/local.py": "", "local.py": "", "sub/deep/.gitignore": "!local.py", "sub/out/y.py": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text or name)
    got = {r["path"].split("/r/", 1)[1] for r in corpus.scan_tree(spark, str(root), nested=True).collect()}
    assert {x for x in got if not x.endswith(".gitignore")} == {"sub/keep.log", "sub/deep/local.py", "local.py", "sub/out/y.py"}


def test_imports_over_lines(spark):
    rows = [
        ("r", "a.rs", "rust", "use a::{b, c::{d, self as e}, f as g};\npub use x::\n  y;\nmod m;\nmod n { use q; }\n// use no;\nlet s = \"use no;\";"),
        ("r", "b.py", "python", "from a.b import (\n  c,\n  d)\nimport x, y.z as w\nfrom . import k\n'''\nimport no\n'''"),
        ("r", "c.ts", "typescript", "import {\n a,\n b\n} from './x'\nimport './side';\nexport * from \"../y\";\nconst z = require('z');\nconst w = import('w')\nconst s = 'from'"),
        ("r", "d.cs", "csharp", "using System.Text;\nusing (var x = y) { }\nusing static A.B;"), ("r", "e.x", None, None),
    ]
    got = {(r["path"], r["source"]) for r in structure.imports(spark.createDataFrame(rows, "repository_id string, path string, language string, content string")).collect()}
    assert got == {
        ("a.rs", "a::b"), ("a.rs", "a::c::d"), ("a.rs", "a::c::self"), ("a.rs", "a::f"), ("a.rs", "x::y"), ("a.rs", "m"), ("a.rs", "q"),
        ("b.py", "a.b"), ("b.py", "x"), ("b.py", "y.z"), ("b.py", "."), ("c.ts", "./x"), ("c.ts", "./side"), ("c.ts", "../y"), ("c.ts", "z"), ("c.ts", "w"), ("d.cs", "System.Text"), ("d.cs", "A.B"),
    }


def test_small_things(spark):
    h = spark.range(1).select(paths.task_hash(F.lit("how é"), 8000, ["docs", "code"], F.lit("abc")).alias("h")).first()["h"]
    assert h == hashlib.sha256("how é".encode() + (8000).to_bytes(8, "big") + b"docs,code" + b"abc").hexdigest()[:16]
    k = spark.createDataFrame([("c", "k", "r", 0.5), ("c", "l", "r", 0.9), ("d", "k", "q", 0.7)], "category string, key string, repository_id string, confidence double")
    assert [r["key"] for r in knowledge.rows_of(k, category="c").collect()] == ["l", "k"] and knowledge.rows_of(k).count() == 3 and knowledge.rows_of(k, "d", "k", "q").count() == 1
    assert knowledge.is_initialised(k, "q") and not knowledge.is_initialised(k, "z")
    p = context.usage_by_source(spark.createDataFrame([(1, 10, 20, 70)], "query_id int, docs_tokens long, code_tokens long, remaining long")).first()
    assert p["total"] == 30 and p["by_source"] == {"docs_context": 10, "code_context": 20, "metadata": 70}
