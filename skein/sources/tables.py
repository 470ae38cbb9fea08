"""Sinks: keyed stores and what is derived from them, catalog tables, reports, objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import kept, shared_folder  # noqa: F401
from ..operators.scan import numbered
from .log_store import Store


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with their keys. Of new rows with one key the last in order holds (any one without an order)."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of tables in which an earlier table's row stands for its key."""
    both = parts[0].withColumn("_p", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("_p", F.lit(k)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_p")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_p", "_n")


# ------------------------------------------------------------------ derived tables, reports, objects


def in_step(source: DataFrame, derived: DataFrame) -> bool:
    """Whether a derived table has as many rows as its source."""
    return source.count() == derived.count()


def stale_buckets(source: DataFrame, derived: Store) -> list[int]:
    """The buckets of a derived store in which it does not hold the rows that it should (source: these rows). Hashes of buckets are compared, of which there are few, not rows."""
    want, have = derived.fingerprints(source), derived.fingerprints(derived.read())
    both = want.select("bucket", F.struct("n", "h").alias("a")).join(have.select("bucket", F.struct("n", "h").alias("b")), "bucket", "full")
    return sorted(r.bucket for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).collect())


def backfill(source: Store, derived: Store, make) -> list[int]:
    """Brings a derived table in step with its source (make: a function of that table): the buckets that differ, which alone are written anew."""
    rows = make(source.read()).select(derived.columns)
    stale = stale_buckets(rows, derived)
    if stale:
        derived.replace(rows.where(derived._bucket().isin(stale)), stale)
    return stale


def rebuild(source: DataFrame, derived: Store, make) -> None:
    """Writes a derived table anew, whatever it held."""
    derived.write(make(source))


def signals_store(spark: SparkSession, path: str) -> Store:
    """Signals by (keyword, project). Upserts keep one row a key; projects and stop words are deleted by conditions."""
    return Store(spark, path, "keyword string, project string, source string", ["keyword", "project"])


def listed(signals: DataFrame, order: list[str]) -> DataFrame:
    """signals with their place in order."""
    return numbered(signals, order).withColumn("place", F.col("place").cast("int"))


def delete_project(store: Store, project: str) -> None:
    store.delete(F.col("project") == project)


def delete_words(store: Store, words: DataFrame, column: str = "keyword") -> None:
    """Deletes the rows whose keyword is in a table of words (keyword), in any case."""
    w = words.select(F.lower(column).alias("_w")).distinct()
    store.delete_keys(store.read().join(w, F.lower(column) == F.col("_w"), "left_semi"))


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    """An empty table of the catalog, unless it is there."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)


def insert_rows(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Appends to a table of the catalog, by name."""
    rows.select(spark.table(name).columns).write.mode("append").saveAsTable(name)


def json_report(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines in place of what was there; each row is an object."""
    rows.write.mode("overwrite").json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two tables below a folder; both are written before either replaces what was there."""
    spark = nodes.sparkSession
    Store(spark, f"{path.rstrip('/')}/nodes", nodes.schema.simpleString()[7:-1], ["node_id"]).write(nodes)
    Store(spark, f"{path.rstrip('/')}/edges", edges.schema.simpleString()[7:-1], ["from_id", "to_id"]).write(edges)


def load_graph(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    return Store(spark, f"{path.rstrip('/')}/nodes", node_schema, ["node_id"]).read(), Store(spark, f"{path.rstrip('/')}/edges", edge_schema, ["from_id", "to_id"]).read()


def append_to_catalog(text: str, projects: list[dict]) -> str:
    """A YAML catalog (as text) with the projects that it does not have yet added at its end; what is there stays as it is written."""
    import yaml

    data = yaml.safe_load(text) or {}
    have = set(data.get("projects") or {})
    new = {p["project"]: {k: v for k, v in p.items() if k != "project"} for p in projects if p["project"] not in have}
    if not new:
        return text
    body = yaml.safe_dump(new, allow_unicode=True, sort_keys=True, default_flow_style=False)
    head = "" if "projects" in data and data["projects"] else "projects:\n"
    text = text if not text or text.endswith("\n") else text + "\n"
    if not head and list(data)[-1] != "projects":
        return yaml.safe_dump(data | {"projects": data["projects"] | new}, allow_unicode=True, sort_keys=False)
    return text + head + "".join(f"  {line}\n" for line in body.splitlines())


class Objects:
    """Files of any store that Hadoop reaches, by path."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return p.getFileSystem(self._conf), p

    def names(self, prefix: str = "") -> list[str]:
        """Names of all files whose names begin with a prefix, in order."""
        fs, p = self._at("")
        if not fs.exists(p):
            return []
        found, it = [], fs.listFiles(p, True)
        root = fs.makeQualified(p).toString().rstrip("/") + "/"
        while it.hasNext():
            name = it.next().getPath().toString()
            found.append(name.removeprefix(root))
        return sorted(n for n in found if n.startswith(prefix) and not n.rsplit("/", 1)[-1].startswith("."))

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        fs, p = self._at(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def upload(self, local: str, name: str) -> None:
        fs, p = self._at(name)
        fs.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(local), p)

    def download(self, name: str, local: str) -> None:
        fs, p = self._at(name)
        fs.copyToLocalFile(False, p, self._jvm.org.apache.hadoop.fs.Path(local), True)

    def delete(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.delete(p, True)


def in_batches(rows: DataFrame, store: Store, key: str, size: int, transform=None) -> int:
    """Writes rows to a store in batches of about `size` by ranges of a hash of their key, leaving out keys that are there, so that a run that was stopped goes on where it was. How many batches were written."""
    todo = rows.join(store.read().select(key), key, "left_anti")
    n = todo.count()
    batches = max(1, -(-n // size)) if n else 0
    for k in range(batches):
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        store.append(transform(part) if transform else part)
    return batches


def queue(categories: DataFrame, completed: DataFrame) -> DataFrame:
    """(category, priority, place): categories (category, priority) that have not been completed (category), in order of priority, then name."""
    todo = categories.join(completed.select("category"), "category", "left_anti")
    return numbered(todo, ["priority", "category"]).withColumn("place", F.col("place").cast("int"))
