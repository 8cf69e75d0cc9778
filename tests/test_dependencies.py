import json

from strataloom.operators.dependencies import imports_of, unused_dependencies


def files_of(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_imports_over_line_ends(spark):
    text = """import {\n a,\n b\n} from './m';\nimport type { T } from "@s/p/sub"\nimport 'side';\nexport * from 'e';\nconst r = require(\n  "r" )\nawait import(`dyn`)\n@import url("x.css");\n@import 'y'"""
    got = sorted((r.kind, r.specifier) for r in imports_of(files_of(spark, [("a.ts", text), ("b.ts", None)])).collect())
    assert got == [("dynamic_import", "dyn"), ("export", "e"), ("import", "./m"), ("import", "@s/p/sub"), ("import", "side"), ("import", "x.css"), ("import", "y"), ("import", "y"), ("require", "r")]


def test_evidence(spark):
    package = {
        "scripts": {"build": "tool-bin --all && named@2 run", "n": "x/inpath y-dashed"},
        "dependencies": {"multi": "1", "unused": "1", "@s/scoped": "1", "named": "1", "inpath": "1", "dashed": "1", "mentioned": "1", "dotted": "1", "nested-only": "1"},
        "devDependencies": {"typescript": "5", "postcss": "8", "@types/node": "1", "@types/multi": "1", "@types/gone": "1", "@types/s__scoped": "1", "tool": "1", "asked": "1", "asked-by-unused": "1"},
        "peerDependencies": [], "optionalDependencies": {"opt": "1"},
    }
    lock = {"packages": {"": {}, "node_modules/tool": {"bin": {"tool-bin": "x"}, "peerDependencies": {"asked": "1"}}, "node_modules/unused": {"bin": "x", "peerDependencies": {"asked-by-unused": "1"}}, "node_modules/a/node_modules/@s/one": {"bin": "y"}}}
    rows = [
        ("app/package.json", json.dumps(package)), ("app/package-lock.json", json.dumps(lock)), ("app/postcss.config.cjs", "plugins: ['mentioned']"), ("app/src/a.ts", "import {\n x\n} from 'multi';\nimport y from '@s/scoped/deep'; // dotted.x"),
        ("app/sub/package.json", json.dumps({"dependencies": {"multi": "1", "nested": "1"}})), ("app/sub/b.js", "require('nested-only'); require('nested')"), ("package.json", json.dumps({"dependencies": {"multi": "1", "top": "1"}})),
        ("broken/package.json", "{"), ("null/package.json", None), ("other/c.js", "import 'unused'"),
    ]
    got = sorted(map(tuple, unused_dependencies(files_of(spark, rows)).collect()))
    names = lambda f: {r[1] for r in got if r[0] == f}
    assert names("app/package.json") == {"unused", "inpath", "dashed", "dotted", "@types/gone", "asked-by-unused", "opt"}
    assert names("app/sub/package.json") == {"multi"} and names("package.json") == {"top"}
    assert {r[1:] for r in got if r[1] in ("unused", "opt")} == {("unused", "dependencies", 0.65), ("opt", "optionalDependencies", 0.5)}


def test_nothing(spark):
    assert unused_dependencies(files_of(spark, [("a.ts", "import 'x'")])).collect() == []
