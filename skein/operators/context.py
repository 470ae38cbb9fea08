"""Packing an answer's context under a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import numbered, prefix_scan

# Order of node types in a context, and its shares.
PRIORITY = ("PROJECT", "DECISION", "REQUIREMENT", "COMPONENT", "EVIDENCE", "CONSTRAINT", "PATTERN", "ISSUE", "SOURCE_DOC")
SOURCE_SHARE, DOC_SHARE, LEAST_DOCS, LEAST_LEFT = 0.60, 0.25, 2000, 200
NODE_LINES = ("name", "confidence", "description", "key_logic", "rationale", "acceptance_criteria", "summary")
CUT = "\n[... context truncated ...]"


def type_priority(node_type: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), node_type), F.lit(0)) - 1, F.lit(len(PRIORITY)))


def first_nodes(nodes: DataFrame, group: str, n: int = 15) -> DataFrame:
    """The nodes of each group that come first in a context: by type, then id."""
    w = Window.partitionBy(group).orderBy("priority", "node_id")
    return nodes.withColumn("priority", type_priority(F.col("node_type"))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def first_chunks(chunks: DataFrame, group: str, n: int = 20) -> DataFrame:
    """The chunks of each group that come first in a context: by similarity, then id."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("similarity"), "chunk_id")
    return chunks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def within_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: int, head: Column | None = None, least: int = LEAST_LEFT) -> DataFrame:
    """Rows from the first on with taken, what of their size fits into what is left of the budget, until at most `least` is left: the row that crosses the budget is cut and the last one.

    Each row costs its head (its heading's size and what goes around it) besides what is taken. A group of any size is split (prefix_scan); order tells its rows apart.
    """
    cost = F.col(size) + (head if head is not None else F.lit(0))
    rows = prefix_scan(rows, [group], order, {"_before": cost, "_earlier": F.lit(1)})
    left, first = F.lit(budget) - F.col("_before"), F.col("_earlier") == 0
    room = F.greatest(F.lit(0), left - (head if head is not None else F.lit(0)))
    return rows.where(first | (left > least)).withColumn("taken", F.least(F.col(size), room).cast("long")).withColumn("running", (F.col("_before") + cost).cast("long")).drop("_before", "_earlier")


def pack(chunks: list[dict], nodes: list[dict], docs: list[dict], edges: list[dict] = (), tree: list[dict] = (), warnings: list[str] = (), max_chars: int = 22_000, max_nodes: int = 15) -> str:
    """The context of one question, from its top hits (tens of rows): chunks by similarity, documents, nodes by type, edges, requirements, warnings; the first two within shares of their own."""
    out: list[str] = []

    def part(title: str, items: list[tuple[str, str]], budget: int) -> None:
        left = budget
        for k, (head, body) in enumerate(items):
            if k and left <= LEAST_LEFT:
                break
            if not k:
                out.append(f"== {title} ==")
            head = f"--- {head} ---"
            body = body[: max(0, left - len(head) - 4)]
            out.extend((head, body))
            left -= len(body) + len(head) + 4

    best = sorted(chunks, key=lambda c: (-(c.get("similarity") or 0.0), c.get("chunk_id", "")))[:20]
    place = lambda c: f"[{c.get('file_type', '').upper()}] {c.get('file_path', '')}:{c.get('start_line', 0)}-{c.get('end_line', 0)} ({c.get('chunk_label', c.get('chunk_id', ''))}) sim={c.get('similarity') or 0.0:.2f}"
    part("Sources", [(place(c), c.get("content", "")) for c in best], max(LEAST_DOCS, int(max_chars * SOURCE_SHARE)))
    part("Documents", [(f"[{d.get('doc_title', d.get('doc_id', ''))}] {d.get('section', '')} sim={d.get('similarity') or 0.0:.2f}", d.get("content", "")) for d in docs[:6]], max(LEAST_DOCS, int(max_chars * DOC_SHARE)))
    rank = {t: k for k, t in enumerate(PRIORITY)}
    first = sorted(nodes, key=lambda n: (rank.get(n.get("node_type"), len(PRIORITY)), n.get("node_id", "")))[:max_nodes]
    for k, n in enumerate(first):
        out.extend([*(["== Nodes =="] if not k else []), f"--- [{n.get('node_type', '?')}] {n.get('node_id', '?')} ---", *(f"{f}: {n[f]}" for f in NODE_LINES if n.get(f))])
    if edges:
        out.extend(["== Edges ==", *(f"{e.get('from_id')} --[{e.get('edge_type')}]--> {e.get('to_id')}" + (f" ({e['confidence']})" if e.get("confidence") else "") for e in list(edges)[:15])])
    if tree:
        out.extend(["== Requirements ==", *(f"{r.get('node_id', '')}: {(r.get('description') or '')[:100]}" for r in list(tree)[:8])])
    if warnings:
        out.extend(["== Warnings ==", *warnings])
    text = "\n".join(out)
    return text if len(text) <= max_chars else text[:max_chars] + CUT


# ------------------------------------------------------------------ answers


def response(query: str, route: str, nodes: list[str], gate: dict, answer: str | None = None, counts: dict | None = None) -> dict:
    """The structured answer to one question: what is shown, its confidence, the live nodes it rests on, warnings, and how much was retrieved. gate: confidence, warnings, filtered (node ids taken out)."""
    gone = set(gate.get("filtered", ()))
    live = [n for n in dict.fromkeys(nodes) if n not in gone]
    warnings = list(gate.get("warnings", ()))
    shown = ["[ANSWER]", f"  type      : {route}", f"  confidence: {gate.get('confidence', 'PARSE_UNCERTAIN')}", f"  sources   : {', '.join(live[:10])}", f"  warnings  : {'; '.join(warnings) or 'none'}", "", answer or "(no answer was generated)"]
    return {"query": query, "answer": "\n".join(shown), "confidence": gate.get("confidence", "PARSE_UNCERTAIN"), "sources": live, "warnings": warnings, "query_type": route, "llm_answer": answer or "", "stale_filtered": len(gone), **(counts or {})}


def project_list(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project, line, place): PROJECT nodes (node_id, name, board, description) in order, then projects that only chunks (project) have."""
    own = nodes.where("node_type = 'PROJECT'")
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) if c in nodes.columns else F.lit(None).cast("string")
    said = F.coalesce(text("name"), F.substring(text("description"), 1, 60), F.col("node_id"))
    pad = lambda c: F.when(F.length(c) < 25, F.rpad(c, 25, " ")).otherwise(c)
    a = own.select(F.col("node_id").alias("project"), F.concat(pad(F.col("node_id")), F.lit(": "), said, F.coalesce(F.concat(F.lit(" ("), text("board"), F.lit(")")), F.lit(""))).alias("line"), F.lit(0).alias("_p"))
    b = chunks.where("project is not null and project <> ''").select("project").distinct().join(own.select(F.col("node_id").alias("project")), "project", "left_anti")
    b = b.select("project", F.concat(pad(F.col("project")), F.lit(": sources only")).alias("line"), F.lit(1).alias("_p"))
    return numbered(a.unionByName(b), ["_p", "project"]).withColumn("place", F.col("place").cast("int")).drop("_p")


def system_prompt(projects: list[str], template: str = "You answer questions about these projects:\n{projects}\nOnly what the context says counts.\n\nCONTEXT:\n{context}\n\nQUESTION:\n{question}", context: str = "", question: str = "") -> str:
    """The prompt with the list of projects; without a context and question, only what stands before the context."""
    text = template.format(projects="\n".join(f"- {p}" for p in projects), context=context, question=question)
    return text if context or question else text.split("CONTEXT:")[0].strip()
