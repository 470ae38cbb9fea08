"""Sources: files as tables, graphs as JSON, catalogs of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_comments
from ..operators.graph import kept
from .file_source import listed_files

# Languages by extension, and folders that hold no sources.
LANGUAGES = {
    "py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "html": "html", "css": "css", "scss": "scss",
    "v": "verilog", "sv": "systemverilog", "vhd": "vhdl", "vhdl": "vhdl", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp",
    "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "sql": "sql", "sh": "bash", "ps1": "powershell", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "toml": "toml", "ini": "ini", "cfg": "config", "tcl": "tcl", "xdc": "xdc",
}
IGNORED_FOLDERS = ("__pycache__", "node_modules", ".git", ".venv", "venv", "env", ".env", "dist", "build", ".idea", ".vscode", "chroma_db")
# Languages of a project's files by extension, and the largest that is read.
PROJECT_LANGUAGES = {"v": "verilog", "sv": "systemverilog", "vhd": "vhdl", "vhdl": "vhdl", "tcl": "tcl", "xdc": "constraints", "xci": "ip_config", "bd": "block_design", "c": "c", "h": "c_header", "cpp": "cpp", "py": "python", "mk": "makefile", "sh": "shell"}
PROJECT_FILE_BYTES = 500_000
# Extensions and skipped path parts of a training corpus.
CORPUS_CODE, CORPUS_TEXT, CORPUS_SKIP = ("v", "sv", "vhd", "tcl", "xdc", "c", "h", "py"), ("md", "txt", "rst"), ("__pycache__", ".git", "node_modules")
# Files that no exclusion hides, prefixes of reference documents, and what tells their id.
CRITICAL_FILES = ("mig.prj", "*.mmi")
DOC_PREFIXES = ("ug", "pg", "xapp", "wp", "ds")
DOC_ID = r"(ug|xapp|wp|xcn|pg|oslib)(\d+)"
# What a design's files say of its part and board, how many files a project has, and what only scripts of designs hold.
PART = r"(?i)(xc[0-9][a-z][0-9a-z]+[a-z]+-[0-9][a-z]+)"
BOARD = r"(?i)(?:Nexys|Arty|Basys|Zybo|Cora|Genesys|Cmod|ZedBoard|Eclypse|Kria|Pynq|Anvyl)[\s\-_]?[A-Z0-9\-]*"
LEAST_FILES, MOST_FILES, UMBRELLA = 5, 3000, "Projects"
#: Roots of a catalog that are broadcast at most.
MOST_ROOTS = 10_000
MARKERS = ("create_bd_cell", "create_project", "create_bd_design", "set_property -dict", "create_clock")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, recursive: bool = True, most_bytes: int | None = None) -> DataFrame:
    """(path, length, content) of text files; the extension is a glob of the reader, so other files are not opened, and large or blank files are left out."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        r = r.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    df = r.load(path).select("path", "length", "content")
    if most_bytes:
        df = df.where(F.col("length") <= most_bytes)
    return df.select("path", "length", F.decode("content", "UTF-8").alias("content")).where(F.col("content").rlike(r"\S"))


def _language(languages: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in languages.items() for x in kv)), extension(F.col("path")))


def _sources(spark: SparkSession, path: str, extensions: tuple[str, ...], most_bytes: int | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, content) of texts. On a mounted path the listing settles what is opened (file_source.py); on other file systems Spark's own reader is asked, as it knows them all, and skipped folders are dropped after."""
    if "://" in path:
        df = files(spark, path, extensions, most_bytes=most_bytes)
        return df.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))) if skip else df
    return listed_files(spark, path, extensions, most_bytes, skip).select("path", "length", F.decode("content", "UTF-8").alias("content")).where(F.col("content").rlike(r"\S"))


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files outside ignored folders with their language, and a header line before the content."""
    df = _sources(spark, path, tuple(LANGUAGES), skip=IGNORED_FOLDERS).withColumn("language", _language(LANGUAGES))
    return df.where(F.col("language").isNotNull()).withColumn("content", F.concat(F.lit("// File: "), "path", F.lit("\n// Language: "), "language", F.lit("\n\n"), "content"))


def project_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, project, language) of a project's files of 14 kinds, without large and blank ones; the project is the folder's name."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return _sources(spark, path, tuple(PROJECT_LANGUAGES), PROJECT_FILE_BYTES).withColumn("project", F.lit(name)).withColumn("language", _language(PROJECT_LANGUAGES))


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files, each a whole object or list."""
    return spark.read.schema(schema).json(path, multiLine=True)


def pdf_texts(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """(path, content) of all PDF files below a folder: pages joined by lines with [PAGE n] marks. extract: a function of a file's bytes to the texts of its pages, that workers call; by default that of an
    installed reader. A file that fails has no row, as has one without text; the scan goes on."""

    def run(batches):
        import pandas as pd

        pages = extract or _pages
        for b in batches:
            out = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                try:
                    texts = [t for t in pages(bytes(raw))]
                except Exception:
                    continue
                body = "\n".join(f"[PAGE {n}]\n{t}" for n, t in enumerate(texts, 1) if t and t.strip())
                if body:
                    out.append((p, body))
            yield pd.DataFrame(out, columns=["path", "content"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, content string")


def _pages(raw: bytes) -> list[str]:
    import io

    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


def all_documents(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """(path, content, type) of PDF files below a folder and of text files in it."""
    pdf = pdf_texts(spark, path, extract).withColumn("type", F.lit("pdf"))
    return pdf.unionByName(files(spark, path, ("txt", "md"), recursive=False).select("path", "content", F.lit("text").alias("type")))


def corpus_listing(listing: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """(type, path) of a listing (path) of a corpus: PDFs below pdfs/, code below code/ without skipped parts, texts below docs/; without those processed (path)."""
    ext = extension(F.col("path"))
    skip = F.exists(F.array(*map(F.lit, CORPUS_SKIP)), lambda s: F.contains("path", s))
    kind = F.when(F.contains("path", F.lit("/pdfs/")) & (ext == "pdf"), "pdf").when(F.contains("path", F.lit("/code/")) & ext.isin(*CORPUS_CODE) & ~skip, "code").when(F.contains("path", F.lit("/docs/")) & ext.isin(*CORPUS_TEXT), "text")
    rows = listing.select(kind.alias("type"), "path").where("type is not null")
    return rows.join(processed.select("path"), "path", "left_anti").select("type", "path") if processed is not None else rows


def with_language(listing: DataFrame) -> DataFrame:
    """A listing (path) with the language of each file, null for others."""
    return listing.withColumn("language", _language(LANGUAGES))


def language_counts(code: DataFrame) -> DataFrame:
    return code.groupBy("language").agg(F.count("*").alias("n"))


def _name(path: str = "path") -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def _below(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files with the projects under whose roots they are. A root is looked up among the folders of a file, so the join has a key. Few roots are broadcast, else nothing: the files' size is not what their compressed listing tells."""
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    roots = catalog.withColumn("root", F.explode("roots")).withColumn("root", F.regexp_replace("root", "/+$", "")).drop("roots")
    roots = kept(roots)
    roots = F.broadcast(roots) if roots.count() <= MOST_ROOTS else roots.hint("merge")
    return listing.withColumn("root", F.explode(folders)).join(roots, "root").drop("root")


def in_catalog(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """(project, path): files (path) of projects (project, roots, include_exts, exclude_patterns, specific_files): under a root, of an extension, without an excluded part; or named."""
    hit = _below(listing, catalog.select("project", "roots", "include_exts", "exclude_patterns", "specific_files"))
    wanted = F.array_contains("include_exts", extension(F.col("path"))) & ~F.exists("exclude_patterns", lambda p: F.contains("path", p))
    return hit.where(wanted | F.array_contains("specific_files", _name())).select("project", "path").distinct()


def critical_files(listing: DataFrame, catalog: DataFrame, found: DataFrame) -> DataFrame:
    """(project, path): files under a project's roots that no exclusion may hide, without those already found."""
    patterns = [p.replace(".", r"\.").replace("*", "[^/]*") for p in CRITICAL_FILES]
    hit = _below(listing, catalog.select("project", "roots")).where(_name().rlike("^(?:" + "|".join(patterns) + ")$"))
    return hit.select("project", "path").distinct().join(found.select("project", "path"), ["project", "path"], "left_anti")


def reference_documents(listing: DataFrame) -> DataFrame:
    """(path, prefix, doc_id, title) of PDF files (path) whose names begin like reference documents: the first number of a document in the name, or its first 20 characters; and a readable title."""
    low = F.lower(_name())
    prefix = F.coalesce(*(F.when(F.startswith(low, F.lit(p)), F.lit(p)) for p in DOC_PREFIXES))
    stem = F.regexp_replace(_name(), r"\.[^.]*$", "")
    known = F.regexp_extract(F.lower(stem), DOC_ID, 0)
    doc_id = F.when(known != "", known).otherwise(F.regexp_replace(F.substring(F.regexp_replace(F.lower(stem), r"\W", "_"), 1, 20), "^_+|_+$", ""))
    title = F.initcap(F.regexp_replace(F.regexp_replace(stem, "(?i)^[a-z_]*[-_]", ""), "[-_]", " "))
    rows = listing.where(extension(F.col("path")) == "pdf").select("path", prefix.alias("prefix"), doc_id.alias("doc_id"), title.alias("t")).where("prefix is not null")
    return rows.select("path", "prefix", "doc_id", F.concat("t", F.lit(" ("), F.upper("doc_id"), F.lit(")")).alias("title"))


def discovered_projects(listing: DataFrame, scripts: DataFrame, root: str, known: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(project, folder, files, tcl, xdc, part, board) of the folders right below root that look like a design and are not known (project).

    listing: (path); scripts: (path, content) of .tcl and .xdc files. A folder is left out if its name holds a skipped part, if it only holds further projects, if it has too few or too many
    files, no script or constraints, or no script that makes a design. Part and board are the first that its name, scripts and constraints (by path) tell; the board is else the folder's name.
    """
    base = root.rstrip("/") + "/"
    rest = lambda: F.substring("path", F.lit(len(base) + 1), F.length("path"))
    inside = listing.where(F.startswith("path", F.lit(base)) & F.contains(rest(), F.lit("/"))).select(F.split(rest(), "/")[0].alias("folder"), "path", extension(F.col("path")).alias("ext"), (F.split(rest(), "/")[1] == UMBRELLA).alias("umbrella"), (F.size(F.split(rest(), "/")) > 2).alias("deep"))
    own = ~F.contains("path", F.lit("/.git"))
    size = inside.groupBy("folder").agg(F.count("*").alias("files"), F.count_if((F.col("ext") == "tcl") & own).alias("tcl"), F.count_if((F.col("ext") == "xdc") & own).alias("xdc"), F.bool_or(F.col("umbrella") & F.col("deep")).alias("umbrella"))
    from ..functions.text import project_id

    size = size.withColumn("project", project_id(F.col("folder"))).where(f"files between {LEAST_FILES} and {MOST_FILES} and tcl > 0 and xdc > 0 and not umbrella").join(known.select("project"), "project", "left_anti")
    for part in skip:
        size = size.where(~F.contains(F.lower("folder"), F.lit(part.lower())))
    s = scripts.where(F.startswith("path", F.lit(base)) & own).select(F.split(rest(), "/")[0].alias("folder"), "path", "content", extension(F.col("path")).alias("ext"))
    made = F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains("content", m)) & (F.col("ext") == "tcl")
    found = lambda pattern: F.nullif(F.regexp_extract("content", pattern, 0), F.lit(""))
    order = F.struct((F.col("ext") != "tcl").alias("o"), "path")
    told = s.groupBy("folder").agg(F.bool_or(made).alias("made"), F.min_by(found(PART), F.when(found(PART).isNotNull(), order)).alias("part"), F.min_by(found(BOARD), F.when(found(BOARD).isNotNull() & (F.col("ext") == "tcl"), order)).alias("in_script"))
    own_board = F.nullif(F.trim(F.regexp_extract("folder", BOARD, 0)), F.lit(""))
    return size.join(told.where("made"), "folder").select("project", "folder", "files", "tcl", "xdc", F.lower(F.coalesce("part", F.lit(""))).alias("part"), F.coalesce(own_board, F.trim("in_script"), F.col("folder")).alias("board"))


def first_file(listing: DataFrame, pattern: str, by: str = "project") -> DataFrame:
    """(project, path): the first file by path whose name fits a glob."""
    return listing.where(_name().rlike("^" + pattern.replace(".", r"\.").replace("*", "[^/]*") + "$")).groupBy(by).agg(F.min("path").alias("path"))


def main_script(scripts: DataFrame, by: str = "project") -> DataFrame:
    """(project, path): the script that creates most blocks; of equals the first by path."""
    n = F.regexp_count("content", F.lit("create_bd_cell"))
    return scripts.withColumn("n", n).where("n > 0").groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("b")).select(by, "b.path")


def project_bundle(contents: DataFrame, by: str = "project") -> DataFrame:
    """(project, label, content) that describe each project to a reader, of files (project, path, content): its read-me, main script, constraints and main program, each cut to its share."""
    readme = first_file(contents, "README.md", by).withColumn("p", F.lit(0)).unionByName(first_file(contents, "readme.md", by).withColumn("p", F.lit(1)))
    main = first_file(contents, "helloworld.c", by).withColumn("p", F.lit(0)).unionByName(first_file(contents, "main.c", by).withColumn("p", F.lit(1))).unionByName(first_file(contents, "main.cc", by).withColumn("p", F.lit(2)))
    best = lambda df: df.groupBy(by).agg(F.min_by("path", "p").alias("path"))
    parts = [(best(readme), 2500), (main_script(contents.where(extension(F.col("path")) == "tcl"), by), 3000), (first_file(contents, "*.xdc", by), 2000), (best(main), 1500)]
    out = None
    for df, most in parts:
        rows = df.withColumn("most", F.lit(most))
        out = rows if out is None else out.unionByName(rows)
    return out.join(contents.select(by, "path", "content"), [by, "path"]).select(by, F.col("path").alias("label"), F.expr("substring(content, 1, most)").alias("content"))


def graph_json(spark: SparkSession, path: str, node_fields: str = "node_id string, node_type string, name string, description string, project string, confidence string") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON file {nodes: [...], edges: [{from, to, edge_type}]} that may have comments."""
    text = spark.read.text(path, wholetext=True).select(strip_comments(F.col("value")).alias("v"))
    schema = f"struct<nodes:array<struct<{node_fields.replace(' string', ':string')}>>,edges:array<struct<`from`:string,`to`:string,edge_type:string,confidence:string,source:string>>>"
    g = text.select(F.from_json("v", schema).alias("g"))
    nodes = g.select(F.explode("g.nodes").alias("n")).select("n.*")
    edges = g.select(F.posexplode("g.edges").alias("seq", "e")).select(F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"), "e.edge_type", "e.confidence", "e.source", "seq")
    return nodes, edges


def catalog_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """A project catalog with {variables} filled in and defaults applied. Parsed on the driver: a catalog is a configuration."""
    import yaml

    data = yaml.safe_load(text) or {}
    variables, defaults = data.get("variables") or {}, data.get("defaults") or {}

    def fill(s: str) -> str:
        for k, v in variables.items():
            s = s.replace("{" + k + "}", str(v))
        return s

    rows = []
    for name, p in sorted((data.get("projects") or {}).items()):
        lists = [[fill(x) for x in (p.get(f) if p.get(f) is not None else defaults.get(f)) or []] for f in ("roots", "include_exts", "exclude_patterns", "specific_files")]
        lists[1] = [x.lstrip(".").lower() for x in lists[1]]
        rows.append((name, p.get("display_name") or name, *lists))
    return spark.createDataFrame(rows, "project string, display_name string, roots array<string>, include_exts array<string>, exclude_patterns array<string>, specific_files array<string>")
