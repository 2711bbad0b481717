"""Scan of source repositories: one row for each supported file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..functions.text import basename, suffix
from ..settings import get_settings

#: What counts as a source file, which directories are skipped, and languages by suffix.
EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".rb", ".go", ".md", ".mdx", ".txt", ".rst", ".yml", ".yaml", ".json", ".toml", ".html", ".css", ".scss", ".sql", ".sh")
FILENAMES = ("Dockerfile", ".env.example")
SKIP_DIRS = ("node_modules", ".git", "__pycache__", "dist", "build", ".next", "venv", ".venv", ".mypy_cache", ".pytest_cache", "coverage", ".tox", "eggs", ".eggs")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rb": "ruby",
    ".md": "markdown", ".mdx": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml", ".html": "html",
    ".css": "css", ".scss": "scss", ".sh": "shell", ".sql": "sql", ".txt": "text", ".rst": "text",
}


def is_supported(path) -> Column:
    return suffix(path).isin(*EXTENSIONS) | basename(path).isin(*FILENAMES)


def is_skipped(path) -> Column:
    """Any directory of the relative path is one to skip."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def name_glob() -> str:
    """A glob of the names that may be supported, suffixes in any case."""
    any_case = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "{" + ",".join([*("*" + any_case(e) for e in EXTENSIONS), *FILENAMES]) + "}"


def language(path) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(known[suffix(path)], F.lit("text"))


def utf8_text(content: Column) -> Column:
    """The bytes as text without those that aren't UTF-8; replacement characters that the text itself holds stay."""
    mark, held = F.lit("\ufffd"), F.lit("\ue000\ue001fffd\ue001\ue000")
    kept = F.make_valid_utf8(F.replace(content.cast("string"), mark, held))
    return F.replace(F.replace(kept, mark, F.lit("")), held, mark)


def git_metadata(spark: SparkSession, repos_dir: str | None = None) -> DataFrame:
    """(repo_name, file_path, git_commit_sha, git_last_modified_at, git_last_modified_by): each file's last commit.

    One ``git log`` for each repository, in parallel over the cluster's shared folder of repositories; no rows for
    directories that aren't repositories, and where git is missing.
    """
    root = (repos_dir or get_settings().repos_dir).rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [(f.getPath().getName(), f.getPath().toUri().getPath()) for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
    repos = spark.createDataFrame(names, "repo_name string, path string").repartition(max(1, len(names)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for name, path in zip(batch.column("repo_name").to_pylist(), batch.column("path").to_pylist(), strict=True):
                rows = [(name, *r) for r in last_commits(path)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=GIT)

    return repos.mapInArrow(read, ", ".join(f"{c} string" for c in GIT))


GIT = ["repo_name", "file_path", "git_commit_sha", "git_last_modified_at", "git_last_modified_by"]


def last_commits(path: str) -> list[tuple[str, str, str, str]]:
    """(file, sha, time, author) of the last commit of each file of a repository; nothing where git can't read it."""
    import subprocess

    try:
        log = subprocess.run(["git", "-c", "core.quotepath=off", "-C", path, "log", "--name-only", "--format=%x00%H%x1f%aI%x1f%an"], capture_output=True, timeout=600, check=True).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.SubprocessError):
        return []
    seen: dict[str, tuple[str, str, str, str]] = {}
    for entry in log.split("\0")[1:]:
        head, *files = entry.split("\n")
        for f in files:
            if f and f not in seen:
                seen[f] = (f, *head.split("\x1f"))
    return list(seen.values())


def load_repos(spark: SparkSession, repos_dir: str | None = None, git: DataFrame | None = None) -> DataFrame:
    """Files below ``repos_dir``, whose first directories are repositories.

    The size cap and the names of supported files reach the file listing, so others are never read; bytes that aren't UTF-8 are dropped; blank
    files go.  git: optional (repo_name, file_path, git_commit_sha, git_last_modified_at,
    git_last_modified_by), joined by file.
    """
    s = get_settings()
    root = (repos_dir or s.repos_dir).rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob()).load(root).where(F.col("length") <= s.file_size_cap_bytes)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    inside = F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})")
    files = raw.select(F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))).alias("rel"), "content", "length").where(F.contains("rel", F.lit("/")))
    files = files.select(F.split_part("rel", F.lit("/"), F.lit(1)).alias("repo_name"), F.regexp_extract("rel", r"^[^/]*/(.*)$", 1).alias("file_path"), "content", "length")
    out = file_rows(files)
    names = ("git_commit_sha", "git_last_modified_at", "git_last_modified_by")
    if git is None:
        return out.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    return out.join(git.select("repo_name", "file_path", F.substring("git_commit_sha", 1, 8).alias("git_commit_sha"), *names[1:]), ["repo_name", "file_path"], "left")


def file_rows(files: DataFrame) -> DataFrame:
    """What is indexed of files (repo_name, file_path, content as bytes): supported ones outside skipped directories that aren't blank."""
    files = files.where(is_supported("file_path") & ~is_skipped("file_path"))
    files = files.withColumn("content", utf8_text(F.col("content"))).where(F.col("content").rlike(r"\S"))
    return files.select(
        "repo_name",
        "file_path",
        basename("file_path").alias("file_name"),
        suffix("file_path").alias("file_type"),
        language("file_path").alias("language"),
        content_hash("content").alias("content_hash"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        "content",
    )
