"""Facts about projects that files tell by being there or by a line in them: settings, tools, versions, hooks, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import base_name

#: Own table: settings by the end of a path: pattern, kind, purpose. The first that matches counts.
SETTINGS = (
    (r"(?:^|/)\.env(?:\.[\w-]+)?$", "environment", "Variables of the environment"), (r"(?:^|/)(?:docker-)?compose[\w.-]*\.ya?ml$", "containers", "Services in containers"), (r"(?:^|/)Dockerfile[\w.-]*$", "containers", "Container image"),
    (r"(?:^|/)\.github/workflows/[^/]+\.ya?ml$", "automation", "Workflow"), (r"(?:^|/)(?:\.gitlab-ci|azure-pipelines|\.travis)\.yml$", "automation", "Pipeline"), (r"(?:^|/)[jt]sconfig[\w.-]*\.json$", "language", "Compiler settings"),
    (r"(?:^|/)(?:pyproject|Cargo)\.toml$|(?:^|/)(?:package|composer)\.json$|(?:^|/)go\.mod$", "manifest", "Package manifest"), (r"(?:^|/)\.?(?:eslint|prettier|stylelint|golangci|rubocop|flake8)[\w.-]*$", "style", "Style checks"),
    (r"(?:^|/)(?:jest|vitest|pytest|karma|playwright|cypress)[\w.-]*\.(?:ini|[cm]?[jt]s|json)$", "tests", "Test settings"), (r"(?:^|/)(?:vite|webpack|rollup|babel|next|nuxt)\.config\.[cm]?[jt]s$", "build", "Build settings"),
    (r"\.toml$", "settings", "TOML settings"), (r"\.ya?ml$", "settings", "YAML settings"), (r"\.json$", "settings", "JSON settings"), (r"\.(?:ini|cfg|conf|properties)$", "settings", "Plain settings"),
)
#: Own table: package managers by the lock file that each writes, the first that is there counts.
LOCKS = (("bun.lockb", "bun"), ("bun.lock", "bun"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"), ("uv.lock", "uv"), ("poetry.lock", "poetry"), ("Pipfile.lock", "pipenv"), ("Cargo.lock", "cargo"), ("go.sum", "go"))
#: Own table: where a project says which version of a language it needs: language, file, pattern of the version. The first counts.
VERSIONS = (
    ("go", r"^go\.mod$", r"(?m)^go\s+([0-9][\w.]*)"), ("node", r"^\.nvmrc$", r"^\s*v?([0-9][\w.]*)"), ("node", r"^\.node-version$", r"^\s*v?([0-9][\w.]*)"), ("node", r"^package\.json$", r"\"engines\"\s*:\s*\{[^}]*\"node\"\s*:\s*\"[^0-9\"]*([0-9][\w.]*)"),
    ("python", r"^\.python-version$", r"^\s*([0-9][\w.]*)"), ("python", r"^pyproject\.toml$", r"(?m)^(?:requires-python|python)\s*=\s*\"[^0-9\"]*([0-9][\w.]*)"), ("rust", r"^rust-toolchain(?:\.toml)?$", r"(?:channel\s*=\s*\")?([0-9][\w.]*)"),
    ("rust", r"^Cargo\.toml$", r"(?m)^rust-version\s*=\s*\"([0-9][\w.]*)"), ("java", r"^pom\.xml$", r"<(?:java\.version|maven\.compiler\.release)>([0-9][\w.]*)<"),
    *[(lang, r"^\.tool-versions$", rf"(?m)^{name}\s+([0-9][\w.]*)") for lang, name in (("go", "golang"), ("node", "nodejs"), ("python", "python"), ("rust", "rust"), ("java", "java"))],
)
#: Own table: folders and files that hold hooks of a version control system, with their tool.
HOOKS = ((r"^\.husky/([a-z][\w-]*)$", "husky"), (r"^\.githooks/([a-z][\w-]*)$", "git"), (r"^\.?lefthook\.ya?ml$", "lefthook"), (r"^\.pre-commit-config\.ya?ml$", "pre-commit"))
#: Own table: tools of projects with several packages by a file at the root.
SHARED = (("turbo.json", "Turborepo"), ("nx.json", "Nx"), ("lerna.json", "Lerna"), ("rush.json", "Rush"), ("pnpm-workspace.yaml", "pnpm workspaces"), ("go.work", "Go workspaces"))
#: Own table: what a file of learned models, data sets or notebooks ends in.
LEARNING = (
    (r"\.(?:pt|pth|ckpt|safetensors|onnx|h5|keras|gguf|pb|tflite|joblib)$", "model"), (r"\.ipynb$", "notebook"), (r"(?:^|/)(?:data|datasets?|corpus)/(?:.*/)?[^/]+\.(?:csv|tsv|parquet|jsonl|arrow|npz|txt)$", "data"),
    (r"(?:^|/)(?:train|finetune|fine_tune|pretrain|evaluate|infer(?:ence)?|predict)\w*\.py$", "script"),
)
#: Own rules: flags and signs of programs for the command line: kind, extensions, pattern.
COMMAND_LINE = (
    ("flag", (".go",), r"\bflag\.(?:String|Bool|Int|Duration)\w*\(\s*(?:&\w+,\s*)?\"([\w-]+)\""), ("flag", (".py",), r"add_argument\(\s*(?:\"-\w\",\s*|'-\w',\s*)?[\"'](--[\w-]+)"), ("flag", (".js", ".ts"), r"\.option\(\s*[\"'][^\"']*(--[\w-]+)"),
    ("flag", (".rs",), r"\blong\s*=\s*\"([\w-]+)\""), ("program", (".go",), r"\b(os\.Args|cobra\.Command|cli\.App)\b"), ("program", (".py",), r"\b(ArgumentParser|click\.command|sys\.argv|Typer)\b"), ("program", (".js", ".ts"), r"\b(process\.argv|commander|yargs)\b"),
    ("program", (".rs",), r"\b(std::env::args|clap::Parser)\b"), ("program", (".c",), r"\bint\s+main\s*\(\s*int\s+\w+\s*,\s*char\s*\*\*?\s*(\w+)"),
)


def _first(path: Column, rules, place: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(path.rlike(rule[0]), F.lit(rule[place])).otherwise(out)
    return out


def settings(files: DataFrame, rules=SETTINGS) -> DataFrame:
    """project_id, relative, kind and purpose of each file of settings, by the first rule that its path meets."""
    df = files.where(~F.coalesce("is_dir", F.lit(False)) & F.col("relative").isNotNull())
    return df.select("project_id", "relative", _first(F.col("relative"), rules, 1).alias("kind"), _first(F.col("relative"), rules, 2).alias("purpose")).where("kind is not null")


def learning(files: DataFrame, rules=LEARNING) -> DataFrame:
    """project_id, kind (model, notebook, data, script), number of files and the first by path."""
    df = files.where(~F.coalesce("is_dir", F.lit(False)) & F.col("relative").isNotNull()).withColumn("kind", _first(F.col("relative"), rules, 1))
    return df.where("kind is not null").groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("files"), F.min("relative").alias("first"))


def package_managers(files: DataFrame, locks=LOCKS) -> DataFrame:
    """project_id and manager: of the lock files at a project's root the first of the table counts."""
    rank = F.array_position(F.array(*[F.lit(f) for f, _ in locks]), F.col("relative")).cast("int")
    best = files.where(rank > 0).groupBy("project_id").agg(F.min(rank).alias("r"))
    return best.select("project_id", F.element_at(F.array(*[F.lit(m) for _, m in locks]), F.col("r")).alias("manager"))


def versions(src: DataFrame, rules=VERSIONS) -> DataFrame:
    """project_id, language, version and the file that tells it; of several the first of the table, then by path. src: project_id, relative, content."""
    name = base_name(F.col("relative"))
    found = F.array(*[
        F.when(name.rlike(f), F.struct(F.lit(i).alias("i"), F.lit(lang).alias("language"), F.nullif(F.regexp_extract("content", p, 1), F.lit("")).alias("version"))) for i, (lang, f, p) in enumerate(rules)
    ])
    rows = src.where(name.rlike("|".join(sorted({f for _, f, _ in rules})))).select("project_id", "relative", F.explode(F.array_compact(found)).alias("v")).where("v.version is not null")
    order = F.struct(F.col("v.i"), F.size(F.split("relative", "/")), F.col("relative"))
    return rows.groupBy("project_id", "v.language").agg(F.min_by("v.version", order).alias("version"), F.min_by("relative", order).alias("file"))


def hooks(files: DataFrame, rules=HOOKS) -> DataFrame:
    """project_id, tool and hooks: the names of hooks that lie in folders, in order; empty for tools with one file for all."""
    path = F.col("relative")
    met = F.array_compact(F.array(*[F.when(path.rlike(p), F.struct(F.lit(t).alias("tool"), F.nullif(F.regexp_extract(path, p, 1) if "(" in p else F.lit(""), F.lit("")).alias("hook"))) for p, t in rules]))
    # as many hooks as version control knows, so a set per project is small
    return files.select("project_id", F.explode(met).alias("m")).groupBy("project_id", "m.tool").agg(F.array_sort(F.collect_set("m.hook")).alias("hooks"))


def shared_tools(files: DataFrame, rules=SHARED) -> DataFrame:
    """project_id and tool of projects with several packages."""
    table = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    return files.select("project_id", F.try_element_at(table, F.col("relative")).alias("tool")).where("tool is not null").distinct()


def workspaces(globs: DataFrame, folders: DataFrame) -> DataFrame:
    """project_id and path of the folders that the workspace globs of a project name, each once.

    globs: project_id and glob (``packages/*``, ``apps/**``, ``tools/cli``; a leading ``!`` takes folders out again).
    folders: project_id and path. A star stands for one level, two for any number.
    """
    out = F.startswith("glob", F.lit("!"))
    plain = F.regexp_replace(F.regexp_replace("glob", r"^!?(?:\./)?", ""), "/+$", "")
    quoted = F.regexp_replace(plain, r"([.+^$()\[\]{}|\\])", r"\\$1")
    levels = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0000")), F.lit("*"), F.lit("[^/]+")), F.lit("\u0000"), F.lit(".+"))
    # one row per project: its globs are as few as its authors wrote
    asked = globs.where("glob is not null").select(F.col("project_id").alias("_p"), out.alias("_out"), levels.alias("_g"))
    asked = asked.groupBy("_p").agg(*[F.concat(F.lit("^(?:"), F.array_join(F.collect_set(F.when(F.col("_out") == o, F.col("_g"))), "|"), F.lit(")$")).alias(n) for n, o in (("_in", False), ("_not", True))])
    met = folders.join(asked, F.expr("project_id <=> _p")).where(F.rlike("path", F.col("_in")) & ~F.rlike("path", F.col("_not")) & (F.col("_in") != "^(?:)$"))
    return met.select("project_id", "path").distinct()


def command_line(src: DataFrame, rules=COMMAND_LINE) -> DataFrame:
    """project_id, kind (flag, program), name and number of files: what sources tell of a program for the command line."""
    every = [F.when(F.col("extension").isin(*ext), F.transform(F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1))), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("name")))) for k, ext, p in rules]  # noqa: B023
    nothing = F.array().cast("array<struct<kind:string,name:string>>")
    hits = src.select("project_id", "file_id", F.explode(F.flatten(F.array(*[F.coalesce(e, nothing) for e in every]))).alias("h"))
    return hits.select("project_id", "file_id", "h.kind", "h.name").distinct().groupBy("project_id", "kind", "name").agg(F.count(F.lit(1)).alias("files"))
