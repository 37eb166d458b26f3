"""Operators that the tables don't exercise, on fixtures: routes, manifests, trees, streams, merges, graphs."""

import json

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import architecture, commands, conventions, facts, graphs, imports, lines, listing, readmes, routes, rules, selections, stacks, syntax
from tidemark.plans import reports
from tidemark.session import numbered, stored
from tidemark.sources import trees
from tidemark.streaming import changes

SRC = "file_id int, project_id int, path string, extension string, content string"


def test_routes_of_each_framework(spark):
    rows = [
        (1, 1, "/a/app.js", ".js", "const e = require('express')\napp.get('/users', requireAuth, list)\nrouter.post(`/users`, create); router.delete('/x', drop)"),
        (2, 2, "/b/main.go", ".go", "import \"github.com/go-chi/chi\"\nr.Get(\"/h\", health)\nr.Post(\"bad\", x)"),
        (3, 3, "/c/main.go", ".go", "http.HandleFunc(\"/plain\", h)"),
        (4, 4, "/d/v.py", ".py", "import flask\n@app.route('/f')\ndef f(): pass"),
        (5, 5, "/e/u.py", ".py", "import django\nurlpatterns = [path('home', v)]"),
        (6, 6, "/f/C.java", ".java", "import org.springframework.x;\n@RequestMapping(\"/base\")\nclass C {\n@GetMapping(\"/one\")"),
        (7, 1, "/a/app.test.js", ".js", "app.get('/skipped', x)"), (8, 8, "/g/n.js", ".js", "app.get('/no_gate', x)"), (9, 9, "/h/n.rs", ".rs", "use axum;\n.route(\"/ax\", get(h))"),
        (13, 13, "/l/a.py", ".py", "from flask import Flask\n@bp.route('/many', methods=['GET', \"POST\"])\n@app.get('/got')"), (14, 14, "/m/s.ts", ".ts", "import Fastify from 'fastify'\nserver.route({ method: ['PUT', 'GET'], url: '/f' })\nserver.delete('/g', { preHandler: verifyJwt }, drop)"),
        (15, 15, "/n/c.ts", ".ts", "import { Get } from '@nestjs/common'\n@Controller('cats')\n@Get()\n@Post('new')"), (16, 16, "/o/m.go", ".go", "mux.HandleFunc(\"GET /items/{id}\", h)\ncache.Get(\"/k\")"), (17, 17, "/p/m.rs", ".rs", "use actix_web::web;\n#[get(\"/hi\")]\n.route(\"/r\", web::post().to(h))\nweb::resource(\"/s\").route(web::get()).route(web::put())"),
        (18, 18, "/q/m.rs", ".rs", "use axum;\n.route(\"/t\", get(a).post(b))"), (19, 19, "/r/r.js", ".js", "const R = require('koa-router')\nrouter.get('user', '/users/:id', show)"), (20, 20, "/s/detector.js", ".js", "require('express')\napp.all('/d', x)\napp.route('/e').get(a).put(b)"),
        (21, 21, "/t/u.py", ".py", "from django.urls import path\nre_path(r'^old/$', v), path('', home)"), (22, 22, "/u/C.java", ".java", "import org.springframework.x;\n@RequestMapping(value = \"/v\", method = RequestMethod.PUT)"), (23, 23, "/v/a.py", ".py", "import fastapi\n@api.api_route(\"/w\", methods=[\"HEAD\"])\n@api.post('/y')"),
        (10, 10, "/i/e.js", ".js", None), (11, 11, "/j/e.js", ".js", ""), (12, 12, "/k/m.go", ".go", "gorilla/mux\nr.HandleFunc(\"/m\", h).Methods(\"PUT\")\nr.HandleFunc(\"/n\", h)"),
    ]
    got = {(r.framework, r.method, r.route, r.file, r.line, r.auth) for r in routes.routes(spark.createDataFrame(rows, SRC)).collect()}
    assert got == {
        ("express", "GET", "/users", "/a/app.js", 2, "Required"), ("express", "POST", "/users", "/a/app.js", 3, ""), ("express", "DELETE", "/x", "/a/app.js", 3, ""),
        ("chi", "GET", "/h", "/b/main.go", 2, ""), ("net/http", "ALL", "/plain", "/c/main.go", 1, ""), ("flask", "GET", "/f", "/d/v.py", 2, ""),
        ("django", "ALL", "/home", "/e/u.py", 2, ""), ("spring", "GET", "/base/one", "/f/C.java", 4, ""), ("axum", "GET", "/ax", "/h/n.rs", 2, ""),
        ("mux", "PUT", "/m", "/k/m.go", 2, ""), ("mux", "ALL", "/n", "/k/m.go", 3, ""),
        ("flask", "GET", "/many", "/l/a.py", 2, ""), ("flask", "POST", "/many", "/l/a.py", 2, ""), ("flask", "GET", "/got", "/l/a.py", 3, ""), ("fastify", "PUT", "/f", "/m/s.ts", 2, ""), ("fastify", "GET", "/f", "/m/s.ts", 2, ""),
        ("fastify", "DELETE", "/g", "/m/s.ts", 3, "Required"), ("nest", "GET", "/cats", "/n/c.ts", 3, ""), ("nest", "POST", "/cats/new", "/n/c.ts", 4, ""), ("net/http", "GET", "/items/{id}", "/o/m.go", 1, ""),
        ("actix", "GET", "/hi", "/p/m.rs", 2, ""), ("actix", "POST", "/r", "/p/m.rs", 3, ""), ("actix", "GET", "/s", "/p/m.rs", 4, ""), ("actix", "PUT", "/s", "/p/m.rs", 4, ""), ("axum", "GET", "/t", "/q/m.rs", 2, ""), ("axum", "POST", "/t", "/q/m.rs", 2, ""),
        ("koa", "GET", "/users/:id", "/r/r.js", 2, ""), ("express", "ALL", "/d", "/s/detector.js", 2, ""), ("express", "GET", "/e", "/s/detector.js", 3, ""), ("express", "PUT", "/e", "/s/detector.js", 3, ""), ("django", "ALL", "/old", "/t/u.py", 2, ""), ("django", "ALL", "/", "/t/u.py", 2, ""),
        ("spring", "PUT", "/v", "/u/C.java", 2, ""), ("fastapi", "HEAD", "/w", "/v/a.py", 2, ""), ("fastapi", "POST", "/y", "/v/a.py", 3, ""),
    }
    pages = ["pages/api/users/[id].ts", "src/pages/api/index.js", "app/api/x/route.ts", "src/app/route.js", "lib/route.ts", None]
    df = spark.createDataFrame([(p,) for p in pages], "path string").select(routes.page_route(F.col("path")).alias("r"))
    assert [r.r for r in df.collect()] == ["/api/users/[id]", "/api", "/api/x", "/", None, None]


def test_places_in_a_total_order(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "n int, s string").repartition(7)
    got = {r.n: r.place for r in numbered(df, "place", -F.col("n"), F.col("s")).collect()}
    assert got == {n: 50 - n for n in range(50)} and numbered(df.limit(0), "place", F.col("n")).count() == 0


def test_stored_tables_go_when_they_are_replaced(spark):
    import os

    one = stored(spark.range(3).toDF("x"), "a")
    two = stored(one.select((F.col("x") + 1).alias("x")), "b", instead=one)
    assert sorted(r.x for r in two.collect()) == [1, 2, 3] and not os.path.exists(one._stored_at) and os.path.exists(two._stored_at)


def test_scalars(spark):
    one = lambda f, *values: [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]
    assert one(text.normalize_model, "quill-large-2-20260104", "a", "20260104", "-20260104", "", None) == ["quill-large-2", "a", "20260104", "-20260104", "unknown", "unknown"]
    assert one(text.clean_version, "^1.2", ">=2", "~>3", "4", None) == ["1.2", "2", "3", "4", None]
    assert one(text.naming_style, "user-card", "user_card", "UserCard", "userCard", "user", "U", "User_Card", None) == ["kebab", "snake", "pascal", "camel", "unknown", "unknown", "unknown", "unknown"]
    assert one(text.resource_prefix, "/api/users/1", "/users/:id", "/v1/products/x", "/", "/:id", None) == ["/api/users", "/users", "/v1/products", "/", "/", None]
    assert one(text.normalize_command, "Yarn Run Build (in web)", "pnpm test", " make ") == ["npm build", "npm test", "make"]
    assert one(text.title_case, "api rate_limit-x") == ["Api Rate Limit X"]
    assert one(text.clean_markdown, "**b** *i* `c` [l](u)") == ["b i c l"]
    assert one(text.clean_html, "<p>a &amp; b</p>") == ["a & b"]
    assert one(lambda c: text.format_count(c.cast("long")), "999", "1500", "2500000", "3000000000") == ["999", "1.5K", "2.5M", "3.0B"]
    rel = spark.createDataFrame([("/r/a", "/r"), ("/r/a", "/r/"), ("/rx/a", "/r"), ("/r/a", ""), ("/r/a", None), (None, "/r")], "p string, r string")
    assert [r[0] for r in rel.select(text.make_relative(F.col("p"), F.col("r"))).collect()] == ["a", "a", "/rx/a", "/r/a", "/r/a", None]


def test_ignore_patterns(spark):
    paths = ["src/a.py", "build/x", "lib/rebuild.py", "a.log", "d/b.log", "x/c.min.js", "x/c.min.jsx", "top", "sub/top", "tmp/", "tmp/x"]
    df = spark.createDataFrame([(p,) for p in paths], "relative string")
    kept = lambda *p: [r.relative for r in df.where(~listing.ignored(p)).collect()]
    assert kept("*.log", "*.min.js", "build", "", "# x", "!a.log") == ["src/a.py", "x/c.min.jsx", "top", "sub/top", "tmp/", "tmp/x"]
    assert "sub/top" in kept("/top") and "top" not in kept("/top")
    assert [p for p in paths if p not in kept("tmp/")] == ["tmp/", "tmp/x"]


def test_rules_keep_the_first_examples_of_ties_and_nulls(spark):
    rows = [(i, 1, f"/p/{i}.py", ".py", c, i // 2) for i, c in enumerate(["import os\nwith open(x)", "with open(x)", None, "", "import os; with open"])]
    df = spark.createDataFrame(rows, SRC + ", walk_ord long")
    got = rules.patterns(rules.keyword_hits(df, [("r", "with open", (".py",), ("import os",)), ("r", "x", (".py",), ())]), 1).collect()
    assert {(r.name, r.files, tuple(r.examples)) for r in got} == {("with open", 2, ("/p/0.py",)), ("x", 2, ("/p/0.py",))}


def test_lines_of_module_files_and_makefiles(spark):
    mod = "module x\nrequire a/b v1.0\nrequire (\n\tc/d v2.1 // indirect\n\te/f v3.0\n)\ng/h v9.9\n"
    df = spark.createDataFrame([(1, mod), (2, None), (3, "")], "id int, text string")
    got = {(r.id, r.module, r.version) for r in lines.required(lines.lines(df, "id"), "id").collect()}
    assert got == {(1, "a/b", "v1.0"), (1, "e/f", "v3.0")}
    make = spark.createDataFrame([(1, "# Build it\r\nbuild: x\n\tgo\ntest:\n# Old\n# Clean up\nclean:\n")], "id int, text string")
    got = [(r.name, r.comment) for r in lines.commented(lines.lines(make, "id"), "id", r"^([a-z]+):", r"^# (.+)$").orderBy("line").collect()]
    assert got == [("build", "Build it"), ("test", None), ("clean", "Clean up")]
    assert lines.lines(df, "id").where("id = 2").count() == 0 and lines.lines(df, "id").where("id = 3").count() == 1


def test_graphs(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("e", "f"), ("a", "b"), (None, "a")], "src string, dst string")
    assert {tuple(r.nodes) for r in graphs.cycles(df).collect()} == {("a", "b", "c"), ("a", "b")}
    assert {(r.node, r.component) for r in graphs.components(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "e")}
    chain = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(20)], "src string, dst string")
    assert {r.component for r in graphs.components(chain).collect()} == {"00"}
    assert {(r.src, r.dst): r.hops for r in graphs.reachable(chain, 3).collect()}[("03", "06")] == 3
    pairs = spark.createDataFrame([("pkg/x", "cmd/y"), ("cmd/y", "pkg/x"), ("internal/domain/a", "api/b"), ("z", "cmd/y")], "from_path string, to_path string")
    assert {(r.from_layer, r.to_layer) for r in graphs.violations(pairs).collect()} == {("pkg", "cmd"), ("internal", "api")}


def test_imports_lead_to_folders_of_the_project(spark):
    src = [(1, "a/x.ts", "import { f } from './b';\nimport './c'\nfrom './gone'"), (1, "a/y.ts", "from './b' from './a'"), (2, "b/z.ts", "from './a'"), (1, "top.ts", "from './a'"), (1, "lib/b/w.ts", None)]
    files = [(p, r) for p, r, _ in src] + [(1, "b/k.ts"), (1, "z/b/k.ts"), (2, None)]
    got = graphs.edges(spark.createDataFrame(src, "project_id int, relative string, content string"), spark.createDataFrame(files, "project_id int, relative string"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", "b")}


def test_cycles_of_any_length(spark):
    import random

    ring = [(f"{i:02}", f"{(i + 1) % 20:02}") for i in range(20)]
    only = [tuple(r) for r in graphs.cycles(spark.createDataFrame(ring, "src string, dst string")).collect()]
    assert only == [([f"{i:02}" for i in range(20)], 20)]
    random.seed(3)
    pairs = ring + [(f"{random.randrange(60):02}", f"{random.randrange(60):02}") for _ in range(75)]
    edge = {p for p in pairs if p[0] != p[1]}
    back = {}
    for a, b in edge:  # edges from b back to a
        hops, todo = {b: 1}, [b]
        for x in todo:
            for y in (d for s, d in edge if s == x):
                if y not in hops:
                    hops[y] = hops[x] + 1
                    todo.append(y)
        back[a, b] = hops.get(a)
    found = [(r.nodes, r.length) for r in graphs.cycles(spark.createDataFrame(pairs, "src string, dst string")).collect()]
    through = {}
    for nodes, length in found:
        assert nodes[0] == min(nodes) and len(set(nodes)) == length == len(nodes)
        for e in zip(nodes, nodes[1:] + nodes[:1]):
            through[e] = min(length, through.get(e, length))
    assert len(found) == len({tuple(n) for n, _ in found}) and max(through.values()) > 5
    assert through == {e: n for e, n in back.items() if n}


def test_commits_and_branches(spark):
    log = ["feat(ui): x", "fix: y", "ABC-1 z", ":bug: q", "chore(ui): x\nfeat: body", "text", None]
    df = spark.createDataFrame([(m,) for m in log], "message string")
    assert {(r.style, r.commits) for r in conventions.commits(df).collect()} == {("conventional", 3)}
    assert {(r.type, r.scope, r.commits) for r in conventions.commit_parts(df).collect()} == {("feat", "ui", 1), ("fix", "", 1), ("chore", "ui", 1)}
    names = spark.createDataFrame([(b,) for b in ("feat/a", "origin/feature/b", "Bugfix/c", "refs/heads/release/1.0", "main", "feature", "other/x", None)], "b string")
    assert [r[0] for r in names.select(conventions.branch_kind(F.col("b"))).collect()] == ["feature", "feature", "fix", "release", None, None, None, None]
    more = spark.createDataFrame([(m,) for m in (":art: x", "\U0001f3a8 y", "[ABC-12] z", "feat!: a", "feat(a b): c", "feat:d")], "message string")
    assert {(r.style, r.commits) for r in conventions.commits(more).collect()} == {("conventional", 2), ("emoji", 2)}


def test_quick_commands_show_one_of_each_kind_first(spark):
    df = spark.createDataFrame([(1, c) for c in ["make build", "build all", "make test", "yarn build", "npm run build", "make lint", None, "zzz"]], "p int, command string")
    ranked = commands.prioritized(df, ["p"])
    assert [r.command for r in ranked.orderBy("rank").collect()][:2] == ["build all", "make build"]
    assert [r.category for r in commands.quick(ranked, ["p"], 4).orderBy("place").collect()][:3] == ["build", "test", "lint"]


def test_manifests_and_trees(spark, tmp_path):
    (tmp_path / "web" / "src").mkdir(parents=True)
    (tmp_path / "web" / "package.json").write_text(json.dumps({"name": "w", "dependencies": {"express": "^4"}, "devDependencies": {"jest": "1"}, "scripts": {"build": "x"}}))
    (tmp_path / "web" / "src" / "a.TS").write_text("export {}")
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "p"\nversion = "1"\ndependencies = ["flask>=2", "x[a]==1; extra"]\n[tool.ruff]\n')
    (tmp_path / "bad.toml").write_text("= no")
    (tmp_path / "blob.bin").write_bytes(b"\xff\xfe\x00")
    df = trees.tree(spark, str(tmp_path)).cache()
    assert {(r.path, r.extension) for r in df.collect()} >= {("web/src/a.TS", ".ts"), ("pyproject.toml", ".toml")}
    assert df.where("name = 'blob.bin'").first().content is None
    assert {r.path for r in trees.folders(df).collect()} == {"web", "web/src"}
    toml = {r.path: r.m for r in df.where("extension = '.toml'").select("path", trees.toml_manifest("content").alias("m")).collect()}
    assert toml["pyproject.toml"].dependencies == {"flask": ">=2", "x": "[a]==1"} and toml["pyproject.toml"].tools == ["ruff"]
    assert toml["bad.toml"].name is None
    web = df.where("extension = '.json'").select(trees.json_manifest("content").alias("m")).first().m
    assert web.name == "w" and web.dependencies == {"express": "^4", "jest": "1"} and web.scripts == {"build": "x"}
    (tmp_path / "s.jsonl").write_text('{"a":1}\n{"b":2}\n')
    assert [(r.file_name, r.raw) for r in trees.logs(spark, str(tmp_path)).collect()] == [("s.jsonl", '{"a":1}'), ("s.jsonl", '{"b":2}')]


def test_following_a_stream_equals_a_full_run(spark, tmp_path):
    source, target, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    batches = [["src/a.go", "go.mod", "README.md"], ["src/b.py", "Makefile", "x/y"], ["src/a.go", "notes.txt"]]
    for i, paths in enumerate(batches):
        (source / f"{i}.json").write_text("".join(json.dumps({"path": p, "at": f"2026-01-01T00:0{i}:00Z"}) + "\n" for p in paths))
        changes.follow(changes.touched(changes.read_changes(spark, str(source))), ["impact"], "files", str(target), str(mark)).awaitTermination(60)
    stream = {r.impact: r.files for r in changes.followed(spark, ["impact"], "files", str(target)).collect()}
    full = changes.touched(spark.read.schema("path string, at timestamp").json(str(source))).groupBy("impact").count()
    assert stream == {r.impact: r["count"] for r in full.collect()}
    assert stream == {"conventions": 3, "endpoints": 3, "tech_stack": 1, "development": 2, "readme": 1, "commands": 1, "structure": 1}


def test_documents_keep_what_people_wrote(spark):
    old = f"a\n{reports.BEGIN}\nmine 1\n{reports.END}\nb {reports.BEGIN}two{reports.END}"
    df = spark.createDataFrame([(old, "new\n"), ("no marks", "new"), (None, "new")], "old string, new string")
    got = [r[0] for r in df.select(reports.merged(F.col("old"), F.col("new"))).collect()]
    assert got == [f"new\n\n\n{reports.BEGIN}\nmine 1\n{reports.END}\n\n{reports.BEGIN}two{reports.END}", "new", "new"]
    text_ = spark.createDataFrame([(x,) for x in ("plain", "a: b", 'q"', "", None)], "v string")
    assert [r[0] for r in text_.select(reports.yaml_text(F.col("v"))).collect()] == ["plain", '"a: b"', '"q\\""', '""', None]


def test_frameworks_and_databases_of_manifests(spark):
    rows = [(1, "express", "^4.1"), (1, "@prisma/client", "5"), (1, "prisma", "~5"), (1, "pg", "8"), (1, "pg", "8"), (2, "github.com/labstack/echo/v4", "v4.1"), (2, "Actix_Web", ">=4"), (2, None, None), (3, "unknown", "1")]
    df = spark.createDataFrame(rows, "project_id int, package string, version string")
    assert {tuple(r) for r in stacks.frameworks(df).collect()} == {
        (1, "Express.js", "backend", "4.1"), (1, "Prisma", "database", "5"), (2, "Echo", "backend", "v4.1"), (2, "Actix Web", "backend", "4"),
    }
    assert [tuple(r) for r in stacks.databases(df).collect()] == [(1, "PostgreSQL")]
    assert stacks.frameworks(df.limit(0)).count() == 0


def test_readmes(spark):
    text_ = "# T\n## Requirements\n- Go\n- Go\n```sh\n$ make all\n- no\n# c\nplain words\n```\n* Java 17 \n## Other\n- x\n"
    rows = lines.lines(spark.createDataFrame([(1, text_), (2, None)], "id int, text string"), "id")
    assert [(r.ord, r.item) for r in readmes.section_bullets(rows, "id").orderBy("ord").collect()] == [(1, "Go"), (2, "Java 17")]
    assert [r.command for r in readmes.shell_commands(rows, "id").collect()] == ["make all"]
    texts = ["The server answers a Request", "a command with a flag, an option and a table of each column", "x" * 6000, "a table with a column, a team and its owner", "flag", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(readmes.kind(F.col("t"))).collect()] == ["service", "tool", "other", "data", "other", None]
    shown = ["**Parameters**: 7B\nLayers: 32", "layers: 2", "| Hidden size | 4,096 |\n- Context window = 8192 tokens.\nlayers: 1\nlayers: 2", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in shown], "t string").select(readmes.figures(F.col("t"))).collect()]
    assert got == [{"parameters": "7B", "layers": "32"}, None, {"embedding": "4096", "context_length": "8192 tokens", "layers": "1"}, None]
    files = spark.createDataFrame([(1, "README", "b"), (1, "readme.md", "a"), (1, "docs/README.md", "c"), (2, "x", "d")], "project_id int, relative string, content string")
    assert [tuple(r) for r in readmes.first_of(files).collect()] == [(1, "a", "readme.md")]


def test_architecture(spark):
    rows = [(1, "cmd/app/main.go", 10), (1, "cmd/gen/main.go", 900), (1, "cmd/big/main.go", 50), (1, "internal/a/b.go", 1), (2, "ports/x", 1), (2, "adapters/y", 1), (2, "app.py", 1), (2, "main.py", 99), (3, "a.txt", None), (4, None, None)]
    df = spark.createDataFrame(rows, "project_id int, relative string, size long")
    assert {r.project_id: r.style for r in architecture.styles(df).collect()} == {1: "Standard Go Layout", 2: "Hexagonal Architecture", 3: "Flat Layout", 4: "Flat Layout"}
    assert {(r.project_id, r.layer, tuple(r.packages)) for r in architecture.layers(df).collect()} == {(1, "cmd", ("app", "big", "gen")), (1, "internal", ("a",))}
    assert {r.project_id: r.path for r in architecture.entry_points(df).collect()} == {1: "cmd/big/main.go", 2: "app.py"}
    drawn = [r.line for r in reports.tree_lines(df.where("project_id = 1"), 2).orderBy("path").collect()]
    assert drawn == ["- cmd", "  - app", "  - big", "  - gen", "- internal", "  - a"]


def test_python_facts(spark):
    source = "import os, a.b\nfrom x import y\nfrom . import z\n@app.route('/')\nasync def f(n: int):\n    yield n\n@dataclass\nclass C(base.Model): pass\n"
    df = spark.createDataFrame([(1, source, 0), (2, "def (", 0), (3, None, 0), (4, "", 0)], "file_id int, content string, kind int")
    got = {(r.file_id, r.kind, r.value) for r in syntax.python_facts(df).collect()}
    assert got == {(1, k, v) for k, v in (
        ("import", "os"), ("import", "a.b"), ("import", "x"), ("import", "x.y"), ("decorator", "app.route"), ("decorator", "dataclass"), ("function", "async def"),
        ("function", "type hints"), ("function", "generator"), ("class", "class definition"), ("class", "extends:base.Model"),
    )} | {(2, "error", "syntax")}


def test_bursts_end_after_a_gap(spark):
    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:00.4"), ("a", "2026-01-01 00:00:01.5"), ("b", "2026-01-01 00:00:00"), ("b", None)]
    df = spark.createDataFrame(rows, "k string, at string").withColumn("at", F.to_timestamp("at"))
    assert sorted((r.k, r.events) for r in changes.bursts(df, "k", 1).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_bursts_go_on_over_the_seams_of_slices(spark):
    import random

    random.seed(2)
    start, at, rows = 1_767_225_600, 0, []
    for i in range(300):
        at += random.choice([0, 1, 4, 9, 10, 11, 40])
        rows.append((random.choice("aab"), start + at, f"p{i % 7}"))
    df = spark.createDataFrame(rows, "k string, s long, path string").withColumn("at", F.timestamp_seconds("s"))
    want = []
    for k in "ab":
        mine = sorted((s, p) for x, s, p in rows if x == k)
        for i, (s, p) in enumerate(mine):
            if i and s - mine[i - 1][0] < 10:
                want[-1][1:] = [want[-1][1] + 1, want[-1][2], s, want[-1][4] | {p}]
            else:
                want.append([k, 1, s, s, {p}])
    for slice_ in (10, 25, 86_400):
        got = changes.bursts(df, "k", 10, members="path", slice_=slice_).select("k", "events", F.unix_seconds("first"), F.unix_seconds("last"), "path").collect()
        assert sorted([*map(list, got)], key=repr) == sorted([[*w[:4], sorted(w[4])] for w in want], key=repr)


def test_imports_and_the_longest_name_that_a_table_holds(spark):
    src = [
        (1, 1, "/p/a.py", ".py", "a.py", "import os\nfrom flask.views import View\n  import flask_login", 2), (2, 1, "/p/lib/b.ts", ".ts", "lib/b.ts", "import React from 'react'\nimport './c'\nconst e = require('express/lib')", 1),
        (3, 1, "/p/lib/main.java", ".java", "lib/main.java", "import java.util.List;\nimport java.io.File;\nimport static java.util.Map.of;", 3), (4, 1, "/p/lib/x_test.go", ".go", "lib/x_test.go", "import (\n\t\"fmt\"\n\tg \"github.com/gin-gonic/gin/v2\"\n)", 4), (5, 1, "/p/n.rs", ".rs", "n.rs", None, 5),
    ]
    df = spark.createDataFrame(src, "file_id int, project_id int, path string, extension string, relative string, content string, walk_ord int")
    found = imports.every_import(df)
    assert {(r.file_id, r.name) for r in found.collect()} == {
        (1, "os"), (1, "flask.views"), (1, "flask_login"), (2, "react"), (2, "./c"), (2, "express/lib"), (3, "java.util.List"), (3, "java.io.File"), (3, "java.util.Map.of"), (4, "fmt"), (4, "github.com/gin-gonic/gin/v2"),
    }
    told = {r.framework: (r.category, r.files, r.examples) for r in imports.told(found).collect()}
    assert told["Flask"] == ("web", 1, ["/p/a.py"]) and told["collections"][1] == told["standard library"][1] == 1 and told["Gin"][1] == told["Express"][1] == told["React"][1] == 1 and len(told) == 8
    got = {r.package: (r.files, r.tests, r.main, r.names) for r in imports.packages(df, found).collect()}
    assert got["lib"][:3] == (3, 1, True) and got[""] == (2, 0, False, ["flask.views", "flask_login", "os"]) and len(got["lib"][3]) == 8
    edges = spark.createDataFrame([(1, "api/a", "db/b"), (1, "api", "api/x"), (1, "api/c", "core"), (1, "db", "core")], "project_id int, src string, dst string")
    assert {r.layer: r.needs for r in imports.layer_needs(edges).collect()} == {"api": ["core", "db"], "db": ["core"]}


def test_short_forms_tell_what_they_leave_out(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), (None, 7)], "k string, n int")
    got = {(r.k, r.n, r.place, r.left_out) for r in selections.capped(df, ["k"], [F.col("n")], 2).collect()}
    assert got == {("a", 0, 1, 3), ("a", 1, 2, 3), ("b", 1, 1, 0), (None, 7, 1, 0)}
    assert {(r.k, r.shown, r.left_out) for r in selections.across(df.where("k is not null"), "k", [F.desc("k")], 4).collect()} == {("b", 1, 0), ("a", 3, 2)}
    assert {(r.k, r.shown, r.left_out) for r in selections.across(df.where("k is not null"), "k", [F.col("k")], 3).collect()} == {("a", 3, 2), ("b", 0, 1)}
    assert [(r.n, r.place) for r in selections.filled(df.where("k = 'a'"), ["k"], F.col("n") == 4, [F.col("n")], 3).orderBy("place").collect()] == [(4, 1), (0, 2), (1, 3)]


def test_facts_that_files_tell(spark):
    files = [(1, p, False) for p in ("yarn.lock", "package-lock.json", ".env.local", "web/Dockerfile", ".github/workflows/ci.yml", "tsconfig.json", "a/b.yaml", ".husky/pre-commit", ".husky/_", ".pre-commit-config.yaml", "turbo.json", "m/x.onnx", "m/y.pt", "n.ipynb", "data/train.csv", "train_model.py", "x.png")] + [(2, "uv.lock", False), (2, "z.toml", True), (3, None, None)]
    df = spark.createDataFrame(files, "project_id int, relative string, is_dir boolean")
    assert {(r.relative, r.kind) for r in facts.settings(df).where("kind <> 'settings'").collect()} == {
        (".env.local", "environment"), ("web/Dockerfile", "containers"), (".github/workflows/ci.yml", "automation"), ("tsconfig.json", "language"),
    }
    assert {r.project_id: r.manager for r in facts.package_managers(df).collect()} == {1: "yarn", 2: "uv"}
    assert {(r.tool, tuple(r.hooks)) for r in facts.hooks(df).collect()} == {("husky", ("pre-commit",)), ("pre-commit", ())}
    assert [tuple(r) for r in facts.shared_tools(df).collect()] == [(1, "Turborepo")]
    assert {(r.kind, r.files, r.first) for r in facts.learning(df).collect()} == {("model", 2, "m/x.onnx"), ("notebook", 1, "n.ipynb"), ("data", 1, "data/train.csv"), ("script", 1, "train_model.py")}
    src = [(1, 1, "go.mod", ".mod", "module x\ngo 1.22.1\n"), (2, 1, ".tool-versions", "", "golang 1.20\nnodejs 20.1\n"), (3, 1, "pyproject.toml", ".toml", 'requires-python = ">=3.11"'), (4, 1, "c/m.go", ".go", 'flag.String("out", "", "")\nflag.BoolVar(&v, "v", false, "")\nos.Args'),
           (5, 2, "m.py", ".py", "p = ArgumentParser()\np.add_argument('-x', '--xs')\np.add_argument('--ys')"), (6, 2, "n.py", ".py", None), (7, 1, "sub/go.mod", ".mod", "go 1.19")]
    src = spark.createDataFrame(src, "file_id int, project_id int, relative string, extension string, content string")
    assert {(r.language, r.version, r.file) for r in facts.versions(src).collect()} == {("go", "1.22.1", "go.mod"), ("node", "20.1", ".tool-versions"), ("python", "3.11", "pyproject.toml")}
    assert {(r.project_id, r.kind, r.name) for r in facts.command_line(src).collect()} == {(1, "flag", "out"), (1, "flag", "v"), (1, "program", "os.Args"), (2, "flag", "--xs"), (2, "flag", "--ys"), (2, "program", "ArgumentParser")}


def test_workspace_globs(spark):
    globs = spark.createDataFrame([(1, "packages/*"), (1, "./apps/**/"), (1, "!packages/old"), (1, "packages/*"), (2, "tool.s"), (3, None)], "project_id int, glob string")
    folders = ["packages", "packages/a", "packages/a/b", "packages/old", "apps/x", "apps/x/y", "tools", "tool.s", None]
    df = spark.createDataFrame([(p, f) for p in (1, 2, 3) for f in folders], "project_id int, path string")
    assert sorted(tuple(r) for r in facts.workspaces(globs, df).collect()) == [(1, "apps/x"), (1, "apps/x/y"), (1, "packages/a"), (2, "tool.s")]


def test_commands_of_manifests_makefiles_and_programs(spark):
    src = [
        (1, 1, "Makefile", "# Build it\nbuild: dep\n\tgo\nVAR := 1\ntest: ## Run tests\n.PHONY: x\n%.o: y\n"), (2, 1, "go.mod", "module x"), (3, 1, "cmd/a.go", 'Use:   "scan [path]",\nShort: "Scan it",\n}\nx{Use: "bare"}\ny{ Use: "sync", Aliases: z, Short: "Sync" }'),
        (4, 2, "pyproject.toml", "[tool.pytest.ini_options]\n"), (5, 2, "sub/go.mod", ""), (6, 2, "Makefile", None),
    ]
    df = spark.createDataFrame([(i, p, r, r, c) for i, p, r, c in src], "file_id int, project_id int, path string, relative string, content string")
    assert {tuple(r) for r in commands.of_makefiles(df).collect()} == {(1, "make build", "Build it"), (1, "make test", "Run tests")}
    assert {tuple(r) for r in commands.of_programs(df).collect()} == {(1, "scan", "Scan it"), (1, "sync", "Sync")}
    assert {(r.project_id, r.command) for r in commands.given(df).collect()} == {(1, "go build ./..."), (1, "go test ./..."), (1, "go vet ./..."), (2, "pytest")}
    manifests = spark.createDataFrame([(1, '{"scripts": {"dev": "vite"}}'), (2, '{"scripts": {"dev": "x"}}'), (3, "{}")], "project_id int, c string").select("project_id", trees.json_manifest("c").alias("m"))
    managers = spark.createDataFrame([(1, "yarn")], "project_id int, manager string")
    assert {tuple(r) for r in commands.of_scripts(manifests, managers).collect()} == {(1, "yarn dev", "vite"), (2, "npm run dev", "x")}


def test_ignore_files_commits_and_repositories(spark, tmp_path):
    files = spark.createDataFrame([(1, ".gitignore", "# c\n\n*.log \r\n!keep\n*.log"), (1, "sub/.gitignore", "x"), (2, ".ignore", None)], "project_id int, relative string, content string")
    assert {tuple(r) for r in trees.ignore_patterns(files).collect()} == {(1, "*.log"), (1, "!keep")}
    (tmp_path / "log.txt").write_text("h1\tAnn\t2026-01-01T00:00:00Z\tfeat: a\tb\nh2\tBo\tnever\tx\nshort\n")
    assert [(r.hash, r.author, r.subject) for r in trees.commits(spark, str(tmp_path)).collect()] == [("h1", "Ann", "feat: a\tb")]
    remotes = ["https://host.example/team/tool.git", "git@host.example:team/sub/tool.git", "ssh://git@host.example:22/team/tool", "no", None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(x,) for x in remotes], "r string").select(trees.repository(F.col("r"))).collect()]
    assert got == [("host.example", "team", "tool"), ("host.example", "team/sub", "tool"), ("host.example", "team", "tool"), None, None]
    assert spark.createDataFrame([("/srv/my app/x.y",)], "p string").select(trees.project_folder(F.col("p"))).first()[0] == "-srv-my-app-x-y"


def test_marked_stretches_return_to_their_sections(spark):
    B, E = reports.BEGIN, reports.END
    old = f"# T\n\n## Use\ntext\n{B}\n## Use\nmine\n{E}\n{B}loose{E}\n"
    new = "# T2\nintro\n## Setup\ns\n## Use\nu"
    one, two = spark.createDataFrame([(1, old), (2, "plain"), (3, None)], "id int, text string"), spark.createDataFrame([(1, new), (2, "new")], "id int, text string")
    assert [r[0] for r in one.orderBy("id").select(reports.has_custom(F.col("text"))).collect()] == [True, False, False]
    assert one.where("id = 1").select(reports.without_marks(F.col("text"))).first()[0] == old.replace(B, "").replace(E, "")
    assert [(r.ord, r.kind, r.title) for r in reports.parts(one, "id").where("id = 1").orderBy("ord").collect()][:4] == [(1, "generated", "Use"), (2, "custom", "Use"), (3, "generated", None), (4, "custom", None)]
    got = {r.id: r.text for r in reports.merged_by_title(one, two, "id").collect()}
    assert got == {1: f"# T2\nintro\n\n## Setup\ns\n\n## Use\nu\n\n{B}\n## Use\nmine\n{E}\n\n{B}loose{E}", 2: "new"}


def test_bursts_tell_what_to_compute_anew(spark):
    rows = [(1, "src/a.go", 0), (1, ".git/index", 1), (1, "x.swp", 2), (1, "go.mod", 3), (1, "src/b.go", 100), (2, "notes.odd", 0), (2, None, 1)]
    df = changes.relevant(spark.createDataFrame(rows, "k int, path string, s long").withColumn("at", F.timestamp_seconds("s")))
    results = {"routes": ("endpoints",), "stack": ("tech_stack",), "docs": ("readme",)}
    found = changes.bursts(df, "k", 10, members="path")
    got = {(r.k, r.first.second + 60 * r.first.minute): (r.full, r.rerun, r.said) for r in changes.dispatched(found, results).withColumn("said", changes.described(F.col("path"), 1)).collect()}
    assert got == {(1, 0): (False, ["routes", "stack"], "go.mod and 1 more"), (1, 100): (False, ["routes"], "src/b.go"), (2, 0): (True, ["docs", "routes", "stack"], "notes.odd")}
    assert {r.full for r in changes.dispatched(found.where("k = 1"), results, known=("stack",)).collect()} == {True}
